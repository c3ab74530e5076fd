"""A build database (SQLite) as a Spark data source.

    register(spark)
    spark.read.format("build_db").option("path", "build.db").option("table", "rule_results").load()

The rows are read in the executors, in partitions of id ranges, each over its own
read-only connection, so the file must lie where executors reach it. A missing file, a
folder or another schema version is an error.
"""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..shared import reach_workers

#: The stored format's version.
VERSION = 17
TABLES = {"info": schema.INFO, "key_names": schema.KEY_NAMES, "rule_results": schema.RULE_RESULTS}
ID = {"info": "id", "key_names": "id", "rule_results": "key_id"}
ROWS = 100_000


def connect(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no build database: {path}")
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class BuildDBReader(DataSourceReader):
    def __init__(self, path: str, table: str, client_version: int | None):
        self.path, self.table = path, table
        with connect(path) as db:
            found = db.execute("SELECT version, client_version FROM info LIMIT 1").fetchone()
            if found is None or found[0] != VERSION or client_version is not None and found[1] != client_version:
                raise ValueError(f"{path}: version {found}, not {(VERSION, client_version)}")
            self.low, self.high = db.execute(f"SELECT min({ID[table]}), max({ID[table]}) FROM {table}").fetchone()

    def partitions(self):
        if self.low is None:
            return [Range(0, 0)]
        return [Range(a, min(a + ROWS, self.high + 1)) for a in range(self.low, self.high + 1, ROWS)]

    def read(self, partition: Range):
        columns = [c.strip("` ") for c in (x.strip().rpartition(" ")[0] for x in TABLES[self.table].split(","))]
        binary = {"key", "value", "dependencies"}
        # a key of digits alone may be stored as a number; all keys are given as bytes
        chosen = ", ".join(f'CAST("{c}" AS BLOB)' if c in binary else f'"{c}"' for c in columns)
        with connect(self.path) as db:
            yield from db.execute(f"SELECT {chosen} FROM {self.table} WHERE {ID[self.table]} >= ? AND {ID[self.table]} < ?", (partition.low, partition.high))


class BuildDB(DataSource):
    @classmethod
    def name(cls) -> str:
        return "build_db"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> BuildDBReader:
        version = self.options.get("client_version")
        return BuildDBReader(self.options["path"], self.options["table"], int(version) if version is not None else None)


def register(spark: SparkSession) -> None:
    reach_workers(spark)
    spark.dataSource.register(BuildDB)


def read(spark: SparkSession, path: str, table: str, client_version: int | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("build_db").option("path", path).option("table", table)
    return (reader if client_version is None else reader.option("client_version", client_version)).load()
