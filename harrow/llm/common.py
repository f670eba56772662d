"""What several operators share: reading a table, stretches of long texts, components."""

from __future__ import annotations

import ctypes
import gc
import time
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from harrow.checkpoints import cut, cut_counted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, modulus: int):
    """crc32 of an integer column written as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus))


def stretches(text: str, limit: int = 1 << 20):
    """``text`` in pieces of about ``limit`` characters, each cut after one of six ASCII blanks.

    Bounds the memory that word lists of a very long text take; no word is split.
    """
    at, n = 0, len(text)
    while n - at > limit:
        end = at + limit
        while end < n and text[end - 1] not in " \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end]
        at = end
    if at < n or not n:
        yield text[at:]


def tidy() -> None:
    """Gives the machine back what this worker has freed; Arrow's pool and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run):
    """``run`` for mapInArrow, whose task starts without what earlier ones have freed and leaves nothing such behind."""

    def whole(batches):
        tidy()
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


@contextmanager
def _setting(spark: SparkSession, key: str, value):
    """``key`` is ``value`` inside, and what it was before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """What is computed inside goes to workers in Arrow batches of at most ``rows`` rows: Spark and the worker both hold a batch, whole texts and all."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    with _setting(spark, key, before if before is not None and 0 < int(before) <= rows else rows):
        yield


def unsent(spark: SparkSession):
    """Joins of what was shuffled stay joins inside: adaptive execution would bring small sides to the driver, each by a job and a thread that lives on for a minute."""
    return _setting(spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", -1)


def forgetful(forget, run):
    """``run`` for mapInArrow, whose memory of words ends with its task: workers live on, other operators need the room.

    forget: a module's function, so that it reaches the worker's own memory and not a copy.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            forget()

    return tidied(whole)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b, never null).

    component is the smallest node that can be reached. Large-star and small-star
    steps alternate until nothing changes: each is one aggregation and one join,
    which adaptive execution can split where a node has very many links.
    """
    spark = links.sparkSession
    links = compact(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        with unsent(spark):
            links, now = _starred(links)
        links = links.coalesce(_tasks(now[0]))
        release(spark)
        if now == last:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        last = now


def _starred(links: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """``links`` after a large-star and a small-star step, and how many they are with a hash of them, observed on the way to the checkpoint folder."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    links = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a row for each link: equal ones wait for the end of the step
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    ends = F.when(F.col("b") == F.col("m"), F.array("a")).otherwise(F.array("a", "b"))
    seen = Observation()
    links = links.join(least, "a").select(F.explode(ends).alias("a"), F.col("m").alias("b")).distinct()
    links = cut(links.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
    return links, (seen.get["n"], seen.get["x"])


def _tasks(rows: int) -> int:
    return max(2, -(-rows // 100_000))


def compact(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept in the checkpoint folder, to be read by no more tasks than these small rows are worth."""
    kept, n = cut_counted(df)
    return kept.coalesce(_tasks(n))


_RELEASED = [0.0]


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps, which it does once the driver has dropped them; once a second at most."""
    if time.monotonic() - _RELEASED[0] < 1:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _RELEASED[0] = time.monotonic()


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``text`` compressed, for a join that moves it."""

    def run(batches):
        for b in batches:
            packed = [None if not t.is_valid else zstandard.compress(t.as_py().encode("utf-8", "replace"), 3) for t in b.column("text")]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, "text", pa.array(packed, pa.binary()))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema))


def unpacked(cell) -> str | None:
    return zstandard.decompress(cell.as_py()).decode() if cell.is_valid else None
