"""SQLite as a data source: ``spark.read.format("harrow_sqlite")`` and an upserting writer.

Reading splits the id range among tasks. SQLite takes one writer at a time, so a
write is one partition and one transaction for each batch; of several rows of a
URL the last counts, and a row that is there keeps its id.
"""

from __future__ import annotations

import sqlite3
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .records import FIELDS, flat, unflat

TABLE = """
CREATE TABLE IF NOT EXISTS pages (
    id INTEGER PRIMARY KEY AUTOINCREMENT, url TEXT UNIQUE NOT NULL, title TEXT, text TEXT, links TEXT,
    metadata TEXT, crawled_at TEXT, status_code INTEGER, content_type TEXT);
CREATE INDEX IF NOT EXISTS pages_by_time ON pages (crawled_at);
CREATE INDEX IF NOT EXISTS pages_by_status ON pages (status_code);
"""
SCHEMA = "id long, " + ", ".join(f"{c} string" for c in FIELDS)


def init_schema(path: str) -> None:
    """Creates the table and its indexes where they are not there."""
    with sqlite3.connect(path) as c:
        c.executescript(TABLE)


@dataclass
class _Ids(InputPartition):
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options.get("partitions", 4))

    def partitions(self):
        with sqlite3.connect(self.path) as c:
            low, high = c.execute("SELECT min(id), max(id) FROM pages").fetchone()
        if low is None:
            return [_Ids(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Ids(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition):
        with sqlite3.connect(self.path) as c:
            for r in c.execute(f"SELECT id, {', '.join(FIELDS)} FROM pages WHERE id >= ? AND id < ? ORDER BY id", (partition.low, partition.high)):
                yield (r[0], *(None if x is None else str(x) for x in r[1:]))


@dataclass
class _Done(WriterCommitMessage):
    saved: int


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.path, self.batch, self.overwrite = options["path"], int(options.get("batchsize", 500)), overwrite

    def write(self, rows):
        names = ", ".join(FIELDS)
        put = f"INSERT INTO pages ({names}) VALUES ({', '.join('?' * len(FIELDS))}) ON CONFLICT(url) DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in FIELDS[1:])
        saved, held = 0, []
        c = sqlite3.connect(self.path, timeout=60)
        c.executescript(TABLE)
        try:
            for r in rows:
                held.append([r[f] for f in FIELDS])
                if len(held) == self.batch:
                    with c:
                        c.executemany(put, held)
                    saved, held = saved + len(held), []
            with c:
                c.executemany(put, held)
            return _Done(saved + len(held))
        finally:
            c.close()


class SqlitePages(DataSource):
    @classmethod
    def name(cls):
        return "harrow_sqlite"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SqlitePages)


def write_sqlite(records: DataFrame, path: str, batch_size: int = 500, overwrite: bool = False, retries: int = 2, delay: float = 0.2) -> int:
    """Upserts records (the last of a URL counts: by ``crawled_at``, then by place); returns failed write attempts. Tries again with doubled delays."""
    register(records.sparkSession)
    if overwrite:
        with sqlite3.connect(path) as c:
            c.execute("DROP TABLE IF EXISTS pages")
    init_schema(path)
    last = Window.partitionBy("url").orderBy(F.desc("crawled_at"), F.desc("_seq"))
    placed = records.withColumn("_seq", F.monotonically_increasing_id())
    rows = flat(placed.withColumn("_n", F.row_number().over(last)).filter("_n = 1").orderBy("crawled_at", "_seq")).coalesce(1)
    for k in range(retries + 1):
        try:
            rows.write.format("harrow_sqlite").option("path", path).option("batchsize", batch_size).mode("append").save()
            return k
        except Exception:
            if k == retries:
                raise
            time.sleep(delay * 2**k)
    return retries


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """All records in the order of their ids."""
    register(spark)
    raw = spark.read.format("harrow_sqlite").option("path", path).load()
    return unflat(raw.orderBy("id"))


def query(spark: SparkSession, sql: str, params: list | None = None, pages: DataFrame | None = None) -> list[dict]:
    """Any SELECT over the view ``pages`` with ``?`` for parameters; rows as dicts."""
    if pages is not None:
        pages.createOrReplaceTempView("pages")
    return [r.asDict(recursive=True) for r in spark.sql(sql, args=params or []).collect()]
