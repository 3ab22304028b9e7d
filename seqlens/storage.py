"""Work tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by spark.checkpoint.dir. Where that is unset, a temporary folder of its own if the
    executors are threads of the driver, as in tests; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = tempfile.mkdtemp(prefix="seqlens-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """What was written to path is deleted when the driver's JVM ends."""
    system, place = file_system(spark, path)
    system.deleteOnExit(place)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, whoever reads it."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    drop_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._seqlens_place = path
    return out


def write_bucketed(df: DataFrame, path: str, name: str, buckets: int, by: list[str], partition: list[str] | None = None, sort: list[str] | None = None, mode: str = "error") -> None:
    """df at path as a table of the session's catalog, one file a bucket (and partition)."""
    dealt = df.repartition(buckets, *by)
    writer = dealt.write.format("parquet").mode(mode).option("path", path).bucketBy(buckets, *by)
    writer = writer.sortBy(*sort) if sort else writer
    (writer.partitionBy(*partition) if partition else writer).saveAsTable(name)


def bucketed(df: DataFrame, name: str, by: list[str], sort: list[str] | None = None, partition: list[str] | None = None) -> DataFrame:
    """Like stored(), dealt by `by`: what groups, windows or joins by these columns needs no exchange. What reads some values of the
    columns in `partition` reads no others."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    table = "seqlens_" + re.sub(r"\W", "_", path.rsplit("/", 1)[1])
    write_bucketed(df, path, table, int(spark.conf.get("spark.sql.shuffle.partitions")), by, partition, sort)
    drop_at_exit(spark, path)
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    system, place = file_system(spark, path)
    system.delete(place, True)


def drop(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames, once nothing that is still to be computed reads it."""
    for df in frames:
        delete(df.sparkSession, df._seqlens_place)
