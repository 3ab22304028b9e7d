"""Sources and sinks: JSON and JSON-lines records, chains, responses, distributions, and months to search by."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import file_system, stored
from ..schemas import CHAIN, CONSTRAINT, CONSTRAINT_TYPES, RESPONSE, TRAJECTORY


def has_files(spark: SparkSession, path: str, *endings: str) -> bool:
    """Whether path is or holds a file of these endings; looks no further than the first."""
    system, place = file_system(spark, path)
    found = system.listFiles(place, True) if system.exists(place) else None
    while found and found.hasNext():
        if found.next().getPath().getName().endswith(endings):
            return True
    return False


def scan_records(spark: SparkSession, path: str, unwrap: bool = True) -> DataFrame:
    """(file, pos, record as JSON text): lines of *.jsonl; of *.json the items of a list, or of "samples", or the object itself."""
    if not has_files(spark, path, ".jsonl", ".json"):
        raise FileNotFoundError(f"no *.jsonl or *.json in {path}")
    name = F.col("_metadata.file_path")
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(name.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), "value")
    lines = lines.filter(F.trim("value") != "").select("file", "pos", F.col("value").alias("record"))
    whole = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select(name.alias("file"), F.trim("value").alias("v"))
    listed = F.from_json(F.when(F.startswith("v", F.lit("[")), F.col("v")).otherwise(F.get_json_object("v", "$.samples") if unwrap else F.lit(None)), "array<string>")
    items = whole.select("file", F.posexplode(F.coalesce(listed, F.array("v"))).alias("pos", "record"))
    return lines.unionByName(items.withColumn("pos", F.col("pos").cast("long")))


def read_trajectories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines); blank lines are neither. A missing file gives none of both, and a warning."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        warnings.warn(f"{path} is missing", stacklevel=2)
        records = T.StructType([f for f in T.StructType.fromDDL(TRAJECTORY).fields if f.name != "_corrupt_record"])
        return spark.createDataFrame([], records), spark.createDataFrame([], "line string")
    lines = spark.read.text(path).filter(F.trim("value") != "")
    df = lines.select("value", F.from_json("value", TRAJECTORY, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull()
    return df.filter(~bad).select("r.*").drop("_corrupt_record"), df.filter(bad).select(F.col("value").alias("line"))


def event_rows(records: DataFrame) -> DataFrame:
    """(task_id, <event columns>) of the records' events."""
    df = records.select("task_id", F.explode("events").alias("e"))
    return df.select("task_id", "e.step", "e.type", "e.args.*")


def read_chains(spark: SparkSession, path: str, first_line_only: bool = False) -> DataFrame:
    """All chains of all files, or only the one on the first line of each file. Lines that hold none are left out."""
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    if first_line_only:
        # a file's first line lies at the start of its first block; numbers grow along a task's part of a file
        at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        lines = lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value").groupBy("file").agg(F.min_by("value", "at").alias("value"))
    df = lines.select(F.from_json("value", CHAIN, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("c")).select("c.*")
    return df.filter("_corrupt_record is null and chain_id is not null").drop("_corrupt_record")


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One response of each *.json file below path; files that hold something else than an object with a chain_id are left out."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path)
    objects = whole.filter(F.startswith(F.ltrim(F.regexp_replace("value", r"^\s+", "")), F.lit("{")))
    return objects.select(F.from_json("value", RESPONSE).alias("r")).select("r.*").filter("chain_id is not null")


def write_results(responses: DataFrame, blinded: DataFrame, path: str) -> None:
    """All responses, and those of blinded(), which name neither model nor settings."""
    write_json(responses, f"{path}/raw")
    write_json(blinded, f"{path}/blinded")


def constraint_json(c: Column) -> Column:
    """A constraint with its type; fields that it does not have are left out."""
    return F.to_json(c)


def constraint_of_json(json: Column) -> Column:
    """The constraint of a JSON object; raises where the type is unknown."""
    c = F.from_json(json, CONSTRAINT)
    return F.when(c["type"].isin(*CONSTRAINT_TYPES), c).otherwise(F.raise_error(F.concat(F.lit("Unknown constraint: "), json)).cast(CONSTRAINT))


#: Parts of a condition's chains, by a hash of the id.
PARTS = 16


def write_chains(chains: DataFrame, path: str) -> None:
    """Merged by chain_id into what is at path: the same id replaces, others stay. Partitioned by source, condition and a hash of the
    id rather than a file a chain; only partitions that get chains are read and written."""
    spark = chains.sparkSession
    condition = F.when(F.col("chain_id").contains("_shuffled_"), "shuffled").otherwise("real")
    place = ["source", "condition", "part"]
    new = chains.dropDuplicates(["chain_id"]).withColumns({"condition": condition, "part": F.pmod(F.xxhash64("chain_id"), F.lit(PARTS)).cast("int")})
    system, folder = file_system(spark, path)
    if system.exists(folder):
        new = stored(new, "new-chains")
        old = spark.read.schema(new.schema).parquet(path)
        touched = old.join(F.broadcast(new.select(*place).distinct()), place, "left_semi")  # PARTS rows a source and condition at most
        kept = touched.join(new.select("chain_id"), "chain_id", "left_anti")
        new = stored(new.unionByName(kept), "merged-chains")  # what is overwritten is read before
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_distribution(dist: DataFrame, path: str) -> None:
    dist.write.mode("overwrite").partitionBy("source", "level").parquet(path)


def read_distribution(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """yyyy-MM of each month from start to end, both included."""
    span = F.sequence(F.to_date(F.lit(f"{start}-01")), F.to_date(F.lit(f"{end}-01")), F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(span).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def months_of(df: DataFrame, time: str) -> DataFrame:
    """yyyy-MM of each month from a column's first time to its last, both included; none without times."""
    first, last = (F.to_date(F.date_trunc("month", f(time))) for f in (F.min, F.max))
    ends = df.agg(first.alias("first"), last.alias("last"))
    span = F.sequence("first", "last", F.expr("interval 1 month"))
    return ends.select(F.explode(span).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def decoded_blob(content: Column) -> Column:
    """Base64 text to text; bad bytes are replaced."""
    return F.decode(F.unbase64(F.regexp_replace(content, r"\s", "")), "UTF-8")


def results_status(spark: SparkSession, path: str) -> DataFrame:
    """(status, files): complete where there are result files with content below path."""
    system, top = file_system(spark, path)
    files = 0
    if system.exists(top):
        found = system.listFiles(top, True)
        while found.hasNext():
            f = found.next()
            files += f.getPath().getName().endswith(".json") and f.getLen() > 0
    return spark.createDataFrame([("complete" if files else "raw_results_not_available", int(files))], "status string, files bigint")
