"""The versioned distribution: deltas, compaction, versions, and lookups without an exchange on its side."""

import re
import shutil

import pytest
from pyspark.sql import functions as F

from seqlens.operators import refdist as D
from seqlens.plans import queries as Q
from seqlens.sources.distribution import DistributionTable

DATA = "/root/testdata/sf0.01"


def counted(df):
    return {tuple(r[:4]): (r.cnt, tuple(r.first_seen)) for r in df.select("source", "level", "key", "entity", "cnt", "first_seen").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return Q._chain_table(spark, DATA)


@pytest.fixture(scope="module")
def table(spark, rows, tmp_path_factory):
    t = DistributionTable(spark, str(tmp_path_factory.mktemp("dist") / "t"), 4)
    for third in range(3):
        t.append(D.build(rows.filter(F.pmod("task_id", F.lit(3)) == third)))
        if third == 1:
            t.compact()
    return t


def test_the_sum_of_the_deltas_is_the_whole(spark, rows, table):
    assert counted(table.current()) == counted(D.build(rows))
    assert [x["kind"] for x in table.log()] == ["delta", "delta", "base", "delta"]
    assert table.parts() == [3, 4] and table.parts(2) == [1, 2] and table.parts(3) == [3]
    assert counted(table.current(2)) == counted(table.current(3)) == counted(D.build(rows.filter("pmod(task_id, 3) < 2")))


def test_an_update_reads_no_older_version(spark, rows, table):
    other = DistributionTable(spark, table.path + "-other", 4)
    first = D.build(rows.filter("task_id < 5"))
    assert other.append(first) == 1
    shutil.rmtree(f"{other.path}/data/version=1")
    assert other.append(D.build(rows.filter("task_id >= 5"))) == 2  # the first version's rows are gone, and are not missed
    scan = without_adaptive(spark, lambda: table.current())
    assert "version" in re.search(r"PartitionFilters: \[[^\]]*\]", scan)[0] and "IN (3,4)" in scan.replace(" IN (3,4)", "IN (3,4)")


def test_a_table_is_found_again(spark, rows, table):
    again = DistributionTable(spark, table.path + "/", 99)
    assert again.buckets == 4 and counted(again.current()) == counted(table.current())
    spark.sql(f"drop table {table._name()}")  # as in a new session
    assert counted(DistributionTable(spark, table.path).current()) == counted(D.build(rows))


def test_writers_that_meet_or_fail(spark, rows, table):
    t = DistributionTable(spark, table.path + "-race", 2)
    assert t._claim() == 1  # a writer that fails here
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        t._put("00000001.claim", "")
    few = D.build(rows.filter("task_id < 9"))
    assert t.append(few) == 2 and t.parts() == [2] and counted(t.current()) == counted(few)


def test_empty_table(spark, tmp_path):
    t = DistributionTable(spark, str(tmp_path / "none"))
    assert t.current().count() == 0 and t.log() == [] and t.parts() == []


def without_adaptive(spark, make):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def below_exchanges(plan):
    """Lines of table scans that have an exchange above them on their way up."""
    path, out = [], []
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:|+\-*()\d]*", line)[0])
        path = [p for p in path if p[0] < depth]
        path.append((depth, line))
        if "FileScan" in line:
            out.append((line, [p for _, p in path if "Exchange" in p]))
    return out


def test_lookups_shuffle_the_queries_alone(spark, rows, table):
    asked = D.signatures(rows).withColumn("query_id", F.struct("chain_id", "idx"))
    plan = without_adaptive(spark, lambda: table.current())
    assert "Exchange" not in plan
    known = table.current().select("source", "level", "key").distinct()
    assert "Exchange" not in without_adaptive(spark, lambda: known)
    shares = D.with_shares(table.current())
    assert "Exchange" not in without_adaptive(spark, lambda: shares)
    plan = without_adaptive(spark, lambda: D.lookup(asked, table.current()))
    scans = below_exchanges(plan)
    own = [(line, up) for line, up in scans if "seqlens_dist" in line]
    assert own and all("Bucketed: true" in line for line, _ in own)
    # a row of the table is at most exchanged as part of a query's row that found it (joins stack), never before its join
    for line, up in own:
        assert not any("ENSURE_REQUIREMENTS" in u and "entity" in u for u in up), (line, up)


def test_windows_over_chains_need_no_exchange(spark, rows):
    plan = without_adaptive(spark, lambda: D.signatures(rows))
    assert "Exchange" not in plan
