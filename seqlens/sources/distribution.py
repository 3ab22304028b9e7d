"""The distribution as a versioned table of bucketed deltas.

One Parquet table holds all versions, partitioned by version and level and bucketed by (source, key); a log beside it says what each
version is. An update appends the counts of its own batch and reads nothing else; `current` sums the last base and the deltas since
(other versions' partitions are not read); `compact` writes that sum as a new base, and older versions stay readable. As all versions
are dealt alike, summing them and looking keys up needs no exchange on the table's side.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import file_system, write_bucketed

COLUMNS = "source string, level int, key string, entity string, cnt bigint, first_seen struct<chain_id:string,idx:int>"


class DistributionTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        """Opens the table at path, or one that begins there; an existing table keeps its own number of buckets."""
        self.spark, self.path = spark, path.rstrip("/")
        log = self.log()
        self.buckets = log[0]["buckets"] if log else buckets

    def log(self) -> list[dict]:
        """What each version is, in order: its number, kind (delta or base) and buckets."""
        system, place = file_system(self.spark, f"{self.path}/_log")
        if not system.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(place))
        return [self._read(f"{self.path}/_log/{n}") for n in names if n.endswith(".json")]

    def _read(self, path: str) -> dict:
        system, place = file_system(self.spark, path)
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Writes a file of the log; of two writers of the same one fails."""
        system, place = file_system(self.spark, f"{self.path}/_log/{name}")
        stream = system.create(place, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _claim(self) -> int:
        """A version of its own for a writer; one that never finishes leaves its number unused, and its rows are never read."""
        system, place = file_system(self.spark, f"{self.path}/_log")
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        version = 1 + max((int(n.split(".")[0]) for n in names), default=0)
        self._put(f"{version:08d}.claim", "")
        return version

    def _write(self, dist: DataFrame, kind: str) -> int:
        version = self._claim()
        fields = [F.col(n).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in COLUMNS.split(", "))]
        df = dist.select(*fields, F.lit(version).alias("version"))
        write_bucketed(df, f"{self.path}/data", self._name(), self.buckets, ["source", "key"], ["version", "level"], mode="append")
        self._put(f"{version:08d}.json", json.dumps({"version": version, "kind": kind, "buckets": self.buckets}))
        return version

    def _name(self) -> str:
        return f"seqlens_dist_{hashlib.md5(self.path.encode()).hexdigest()}"

    def append(self, dist: DataFrame) -> int:
        """A batch's counts (as refdist.build gives them) as a delta; returns its version."""
        return self._write(dist, "delta")

    def compact(self) -> int:
        """The sum of all as a new base, which later reads start with."""
        return self._write(self.current(), "base")

    def parts(self, version: int | None = None) -> list[int]:
        """Versions that make up the table as of a version (the last): the newest base and the deltas after it."""
        log = [x for x in self.log() if version is None or x["version"] <= version]
        bases = [x["version"] for x in log if x["kind"] == "base"]
        return [x["version"] for x in log if x["version"] >= (bases[-1] if bases else 0)]

    def current(self, version: int | None = None) -> DataFrame:
        """(source, level, key, entity, cnt, first_seen) as of a version (the last)."""
        parts = self.parts(version)
        if not parts:
            return self.spark.createDataFrame([], COLUMNS)
        rows = self._table().filter(F.col("version").isin(parts)).drop("version")
        if len(parts) == 1:
            return rows
        return rows.groupBy("source", "level", "key", "entity").agg(F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))

    def _table(self) -> DataFrame:
        """All versions; a session that has not written the table learns of it from its folder."""
        name, names = self._name(), [c.split(" ", 1)[0] for c in COLUMNS.split(", ")]
        self.spark.sql(
            f"create table if not exists {name} ({COLUMNS}, version int) using parquet partitioned by (version, level)"
            f" clustered by (source, key) into {self.buckets} buckets location '{self.path}/data'"
        )
        self.spark.sql(f"msck repair table {name}")
        return self.spark.table(name).select(*names, "version")
