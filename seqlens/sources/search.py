"""Remote sources with pluggable clients: a search by month, data sets, and fetched pages with a memo.

A client is named as "module:function". A search calls client(query, month, page) -> list of (sha, repo, path, content in
base64), where an empty list ends a month; a data set client(name, split) -> texts of JSON records; a page client(key) ->
(status, text). Network clients are not part of this package.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import file_system
from .files import scan_records


def client_of(name: str) -> Callable:
    module, function = name.split(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Month(InputPartition):
    month: str


def month_range(start: str, end: str) -> list[str]:
    y, m = map(int, start.split("-"))
    out = []
    while f"{y:04d}-{m:02d}" <= end:
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Month]:
        return [Month(m) for m in month_range(self.options["start"], self.options["end"])]

    def read(self, partition: Month) -> Iterator[tuple]:
        client = client_of(self.options["client"])
        for page in count(1):
            rows = client(self.options.get("query", ""), partition.month, page)
            if not rows:
                return
            for sha, repo, path, content in rows:
                yield sha, repo, path, base64.b64decode(content).decode("utf-8", "replace"), partition.month


class SearchSource(DataSource):
    """spark.dataSource.register(SearchSource); spark.read.format("monthly_search").options(start=, end=, client=).load()"""

    @classmethod
    def name(cls) -> str:
        return "monthly_search"

    def schema(self) -> str:
        return "sha string, repo string, path string, content string, month string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        for pos, record in enumerate(client_of(self.options["client"])(self.options["name"], self.options.get("split", "train"))):
            yield self.options["name"], pos, record


class RecordSource(DataSource):
    """(file, pos, record) of a remote data set, as scan_records gives them of files."""

    @classmethod
    def name(cls) -> str:
        return "remote_records"

    def schema(self) -> str:
        return "file string, pos long, record string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def open_records(spark: SparkSession, place: str, client: str, split: str = "train", unwrap: bool = True) -> DataFrame:
    """Records of the files at a path if it exists, else of the remote data set of that name."""
    system, path = file_system(spark, place)
    if system.exists(path):
        return scan_records(spark, place, unwrap)
    spark.dataSource.register(RecordSource)
    return spark.read.format("remote_records").options(name=place, split=split, client=client).load()


#: Answers that mean that there is nothing to have, and the one after which a page is asked for once more.
GONE, BUSY = (404, 422, 451), 403


def fetched(keys: DataFrame, memo: DataFrame, client: str, delay: float = 0.0) -> DataFrame:
    """keys (key), memo (key, body): (key, body) of the distinct keys. Only what the memo lacks is fetched; body is null where there is nothing
    to have."""

    def fetch(batches):
        import time

        import pyarrow as pa

        get = client_of(client)
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                status, body = get(key)
                if status == BUSY:
                    time.sleep(delay)
                    status, body = get(key)
                if status not in (200, *GONE):
                    raise OSError(f"status {status} for {key}")
                out.append(body if status == 200 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["key", "body"])

    distinct = keys.select("key").distinct()
    misses = distinct.join(memo, "key", "left_anti").mapInArrow(fetch, "key string, body string")
    return memo.select("key", "body").join(distinct, "key", "left_semi").unionByName(misses)
