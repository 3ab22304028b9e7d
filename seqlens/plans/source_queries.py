"""Queries that write files made from the driver's tables and read them back through the sources and sinks."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chains as H
from ..operators import refdist as D
from ..operators import score as S
from ..sources import files as X
from ..sources import search as W
from ..storage import drop_at_exit, file_system, shared_dir
from . import sql as Q
from .adapters import events, table
from .queries import _RESP, MODELS, _chain_rows, _chain_table, _rows, _scored
from .queries import ORACLES as _CORE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
HERE = "seqlens.plans.source_queries"


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, oracle
        return f

    return add


def fresh(spark, name: str) -> str:
    place = shared_dir(spark, name)
    drop_at_exit(spark, place)
    return place


def written(lines: DataFrame, place: str, ending: str) -> str:
    """lines (file, n, value): a file of this ending for each number, its lines in the order of n."""
    spark = lines.sparkSession
    lines.repartition("file").sortWithinPartitions("file", "n").select("value", "file").write.partitionBy("file").mode("append").text(place)
    system, top = file_system(spark, place)
    for folder in system.listStatus(top):
        if folder.isDirectory():
            for f in system.listStatus(folder.getPath()):
                old = f.getPath().getName()
                if old.endswith(".txt"):
                    system.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), old.removesuffix(".txt") + ending))
    return place


def document_lines(spark, d) -> DataFrame:
    """A JSON line for each document in seven files, with blank lines between."""
    df = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("file"), (F.col("doc_id") * 2).alias("n"), F.to_json(F.struct("doc_id", "lang")).alias("value"), "doc_id")
    blank = df.filter("doc_id % 10 = 0").select("file", (F.col("n") + 1).alias("n"), F.lit("  ").alias("value"))
    return df.drop("doc_id").unionByName(blank)


def conversation_files(spark, d) -> DataFrame:
    """Files that hold lists of conversations, or an object with such a list as its samples, or an object alone."""
    df = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    some = df.groupBy((F.col("conv_id") % 6).alias("file")).agg(F.to_json(F.sort_array(F.collect_list(F.struct("conv_id", "turns")))).alias("items"), F.min("conv_id").alias("first"))
    samples = F.concat(F.lit('{"version":1,"samples":'), "items", F.lit("}"))
    alone = F.concat(F.lit('{"conv_id":'), F.col("first").cast("string"), F.lit(',"turns":0}'))
    return some.select("file", F.lit(0).alias("n"), F.when(F.col("file") < 2, F.col("items")).when(F.col("file") < 4, samples).otherwise(alone).alias("value"))


def _scanned(spark, d, unwrap: bool) -> DataFrame:
    place = fresh(spark, "records")
    written(document_lines(spark, d), place, ".jsonl")
    written(conversation_files(spark, d), place, ".json")
    got = X.scan_records(spark, place, unwrap)
    part = lambda n: F.get_json_object("record", f"$.{n}").cast("bigint").alias(n)
    return got.select(part("doc_id"), part("conv_id"), part("turns"), F.json_array_length(F.get_json_object("record", "$.samples")).cast("bigint").alias("samples"))


_CONV = "c as (select conv_id, conv_id % 6 as file, count(*) as turns from conversations group by all), f as (select file, min(conv_id) as first, count(*) as n from c group by file)"


@query("record_scan", f"with {_CONV} select doc_id, null::bigint as conv_id, null::bigint as turns, null::bigint as samples from documents union all select null, conv_id, turns, null from c where file < 4 union all select null, first, 0, null from f where file > 3")
def record_scan(spark, d):
    return _scanned(spark, d, True)


@query("record_scan_whole", f"with {_CONV} select doc_id, null::bigint as conv_id, null::bigint as turns, null::bigint as samples from documents union all select null, conv_id, turns, null from c where file < 2"
       " union all select null, null, null, n from f where file in (2, 3) union all select null, first, 0, null from f where file > 3")  # fmt: skip
def record_scan_whole(spark, d):
    """Without unwrapping: an object that holds samples is a record itself."""
    return _scanned(spark, d, False)


def demo_records(name: str, split: str):
    """A data set of fifty records."""
    return (json.dumps({"id": n, "of": f"{name}/{split}"}) for n in range(50))


@query("remote_records", "select i as id, 'far-away/test' as of_ from range(50) t(i) union all select doc_id, 'near' from documents")
def remote_records(spark, d):
    """A name that is no path is a remote data set; a path is scanned."""
    near = written(document_lines(spark, d), fresh(spark, "near"), ".jsonl")
    client = f"{HERE}:demo_records"
    part = lambda n: F.get_json_object("record", f"$.{n}")
    far = W.open_records(spark, "far-away", client, "test").select(part("id").cast("bigint").alias("id"), part("of").alias("of_"))
    return far.unionByName(W.open_records(spark, near, client).select(part("doc_id").cast("bigint").alias("id"), F.lit("near").alias("of_")))


def demo_search(query: str, month: str, page: int):
    """As many pages as the month has units, of two results each."""
    if page > int(month[-1]) + 1:
        return []
    return [(f"{month}-{page}-{k}", "repo", f"{query}/{k}.md", base64.b64encode(f"{query} {month} {page} é".encode()).decode()) for k in range(2)]


@query("search_months", """with o as (select strftime(o_orderdate, '%Y-%m') as m, count(*) as n from orders where o_orderdate is not null group by 1),
    every as (select strftime(m, '%Y-%m') as m from (select unnest(generate_series(date_trunc('month', min(o_orderdate))::timestamp, max(o_orderdate), interval 1 month)) as m from orders))
    select m || '-' || p || '-' || k as sha, 'q/' || k || '.md' as path, 'q ' || m || ' ' || p || ' é' as content, m as month, coalesce(n, 0) as orders
    from every left join o using (m), range(1, 11) t(p), range(2) s(k) where p <= cast(right(m, 1) as int) + 1""")  # fmt: skip
def search_months(spark, d):
    """The results of every month in which orders may lie, each with the number of the month's orders."""
    placed = table(spark, d, "orders").filter("o_orderdate is not null").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("orders"))
    start, end = placed.agg(F.min("month"), F.max("month")).first()
    if start is None:  # no order, no month
        return placed.select(*[F.lit("").alias(c) for c in ("sha", "path", "content")], "month", "orders")
    spark.dataSource.register(W.SearchSource)
    got = spark.read.format("monthly_search").options(start=start, end=end, query="q", client=f"{HERE}:demo_search").load()
    return got.join(placed, "month", "left").select("sha", "path", "content", "month", F.coalesce("orders", F.lit(0)).alias("orders"))


_ASKED: dict[str, int] = {}


def demo_page(key: str):
    """Busy at first for keys of one kind, nothing for those of another."""
    _ASKED[key] = _ASKED.get(key, 0) + 1
    kind = len(key) % 3
    if kind == 1 and _ASKED[key] % 2:
        return 403, ""
    return (404, "") if kind == 2 else (200, f"page of {key}")


@query("fetch_memo", """select key, case when lang = 'en' then 'kept' when length(key) % 3 = 2 then null else 'page of ' || key end as body from (select distinct lang, lang || ':' || source as key from documents)""")
def fetch_memo(spark, d):
    keys = table(spark, d, "documents").select("lang", F.concat_ws(":", "lang", "source").alias("key"))
    memo = keys.filter("lang = 'en'").select("key", F.lit("kept").alias("body")).distinct()
    return W.fetched(keys, memo, f"{HERE}:demo_page")


@query("blob_texts", "select doc_id, md5(text) as digest from documents")
def blob_texts(spark, d):
    blob = F.base64(F.encode("text", "utf-8"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.decoded_blob(blob)).alias("digest"))


# --- trajectories and chains --------------------------------------------------------------------------------------------------


def trajectory_lines(spark, d) -> DataFrame:
    """A line for each user's trajectory in five files, each with a broken line and a blank one."""
    args = F.struct("command", "path", "error_type", "outcome")
    item = F.struct("step", F.struct("type", "step", args.alias("args")).alias("e"))
    df = events(spark, d).groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["e"]).alias("events"))
    whole = F.struct(F.col("task_id").cast("string").alias("task_id"), F.lit("m").alias("model"), F.lit("a").alias("agent"), F.lit("pass").alias("outcome"), F.lit("tb").alias("source"), "events")
    lines = df.select((F.col("task_id") % 5).alias("file"), F.col("task_id").alias("n"), F.to_json(whole).alias("value"))
    files = lines.select("file").distinct()
    broken = files.select("file", F.lit(40).cast("bigint").alias("n"), F.concat(F.lit('{"task_id": broken '), F.col("file").cast("string")).alias("value"))
    return lines.unionByName(broken).unionByName(files.select("file", F.lit(41).cast("bigint").alias("n"), F.lit("").alias("value")))


@query("trajectory_scan", Q.sql(Q.EV, "select cast(task_id as varchar) as task_id, step, type, command, path, error_type, outcome from ev"))
def trajectory_scan(spark, d):
    good, _ = X.read_trajectories(spark, written(trajectory_lines(spark, d), fresh(spark, "trajectories"), ".jsonl"))
    return X.event_rows(good).select("task_id", F.col("step").cast("bigint").alias("step"), "type", "command", "path", "error_type", "outcome")


@query("trajectory_rejects", """select '{"task_id": broken ' || f as line from (select distinct user_id % 5 as f from events)""")
def trajectory_rejects(spark, d):
    """Broken lines go to a log of their own."""
    _, bad = X.read_trajectories(spark, written(trajectory_lines(spark, d), fresh(spark, "trajectories"), ".jsonl"))
    log = fresh(spark, "rejects")
    X.write_json(bad, log)
    return spark.read.schema("line string").json(log)


@query("trajectory_sink", Q.sql(Q.EV, "select cast(task_id as varchar) as task_id, 'pass' as outcome, count(*) as events, max(step) as last from ev group by task_id"))
def trajectory_sink(spark, d):
    """Trajectories written as JSON lines, without their raw records, and read again."""
    good, _ = X.read_trajectories(spark, written(trajectory_lines(spark, d), fresh(spark, "trajectories"), ".jsonl"))
    place = fresh(spark, "logs")
    X.write_json(good, place)
    again, _ = X.read_trajectories(spark, place)
    rows = again.select("task_id", "outcome", F.explode("events").alias("e"))
    return rows.groupBy("task_id", "outcome").agg(F.count("*").alias("events"), F.max("e.step").cast("bigint").alias("last"))


def chain_lines(spark, d) -> DataFrame:
    """Short chain records in thirteen files, in each a broken line after the first."""
    value = F.to_json(F.struct(F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chain_id"), F.col("lang").alias("source"), (F.col("n_chars") % 50).cast("int").alias("cutoff_k")))
    df = table(spark, d, "documents").select((F.col("doc_id") % 13).alias("file"), F.col("doc_id").alias("n"), value.alias("value"))
    first = df.groupBy("file").agg(F.min("n").alias("n"))
    return df.unionByName(first.select("file", (F.col("n") + 1).alias("n"), F.lit("{broken").alias("value")))


@query("chain_scan", "select 'c' || doc_id as chain_id, lang as source, cast(n_chars % 50 as int) as cutoff_k from documents")
def chain_scan(spark, d):
    return X.read_chains(spark, written(chain_lines(spark, d), fresh(spark, "chains"), ".jsonl")).select("chain_id", "source", "cutoff_k")


@query("chain_scan_first", "select 'c' || doc_id as chain_id, lang as source, cast(n_chars % 50 as int) as cutoff_k from documents where doc_id in (select min(doc_id) from documents group by doc_id % 13)")
def chain_scan_first(spark, d):
    """The first line of each file alone, also where files are read in small parts."""
    place = written(chain_lines(spark, d), fresh(spark, "chains"), ".jsonl")
    return X.read_chains(spark, place, first_line_only=True).select("chain_id", "source", "cutoff_k")


@query("result_scan", "select lang as chain_id, source as model, cast(count(*) as int) as seed from documents where lang <> 'en' group by lang, source")
def result_scan(spark, d):
    """A file for each result, below folders; lists and objects without a chain are left out."""
    df = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").cast("int").alias("n"))
    whole = F.to_json(F.struct(F.when(F.col("lang") != "en", F.col("lang")).alias("chain_id"), F.col("source").alias("model"), F.col("n").alias("seed")))
    lines = df.select(F.concat_ws("-", "lang", "source").alias("file"), F.lit(0).alias("n"), whole.alias("value"))
    lists = lines.select(F.concat("file", F.lit("-list")).alias("file"), "n", F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    place = written(lines.unionByName(lists), fresh(spark, "results"), ".json")
    return X.read_responses(spark, place).select("chain_id", "model", "seed")


@query("chain_sink", Q.sql(Q.VALID, """select 'tb' as source, 'real' as condition, 'tb_' || task_id as chain_id, idx, ctype as type, step as ts, coalesce(resource, tool, to_phase, added, dependency, objective) as what from chain"""))
def chain_sink(spark, d):
    """Chains written by source and condition, read again, each constraint once more through its JSON form."""
    chains, _ = H.build_chains(_rows(spark, d), "tb")
    place = fresh(spark, "chain-sink")
    X.write_chains(chains, place)
    df = spark.read.parquet(place).select("source", "condition", "chain_id", F.posexplode("constraints").alias("idx", "c"))
    c = X.constraint_of_json(X.constraint_json(F.col("c")))
    df = df.withColumn("c", c)
    what = F.coalesce("c.resource", "c.tool", "c.to_phase", F.try_element_at("c.observable_added", F.lit(1)), "c.dependency", "c.objective")
    return df.select("source", "condition", "chain_id", F.col("idx").cast("bigint").alias("idx"), "c.type", F.col("c.timestamp").alias("ts"), what.alias("what"))


@query("distribution_sink", Q.sql(Q.SIG, "select 'tb' as source, level, key, entity, cnt from dist"))
def distribution_sink(spark, d):
    place = fresh(spark, "distribution")
    X.write_distribution(D.build(_chain_rows(spark, d)), place)
    return X.read_distribution(spark, place).select("source", "level", "key", "entity", "cnt")


@query("blinded_results", Q.sql(_RESP, """select cast(task_id as varchar) as chain_id, k as cutoff_k, arg_max(response, task_id || ':' || model || ':' || seed || ':' || t) as response, count(*) as raw from resp group by task_id, k"""))
def blinded_results(spark, d):
    """The last response of each chain and cut, without model and settings, beside the raw ones."""
    rows = _chain_table(spark, d)
    made = S.synthetic_responses(rows, MODELS)
    place = fresh(spark, "results")
    X.write_results(made, S.blinded(made), place)
    blind = spark.read.schema("chain_id string, cutoff_k bigint, response string").json(f"{place}/blinded")
    raw = spark.read.schema("chain_id string, cutoff_k bigint").json(f"{place}/raw").groupBy("chain_id", "cutoff_k").agg(F.count("*").alias("raw"))
    return blind.join(raw, ["chain_id", "cutoff_k"])


@query("scored_sink", _CORE["grouping_families"])
def scored_sink(spark, d):
    """Scored cells as JSON lines and back."""
    cells = S.grouping_families(_scored(spark, d))
    place = fresh(spark, "scored")
    X.write_json(cells, place)
    return spark.read.schema(cells.schema).json(place).select(*cells.columns)


def report_line(*columns: str) -> Column:
    """A cell as a line of a report."""
    return F.format_string("%-24s n=%5d hits=%5d rate=%6.2f%%", F.concat_ws("::", *columns), "n", "hits", 100 * F.col("hits") / F.col("n"))


@query("cell_report", Q.sql(_RESP, """select rpad(model || '::tb::' || gt_type, cast(greatest(24, length(model || '::tb::' || gt_type)) as int), ' ') || printf(' n=%5d hits=%5d rate=%6.2f%%', count(*), cast(sum(l1) as bigint), 100.0::double * sum(l1) / count(*)) as line from sc group by model, gt_type"""))
def cell_report(spark, d):
    return S.by_type(_scored(spark, d)).select(report_line("model", "source", "gt_type").alias("line"))
