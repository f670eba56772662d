"""Exact deduplication by a tree merge of digest runs; each merge is a grouped aggregation by digest.

Every input partition makes one run: its distinct digests, each with the best row
seen and a count. Runs meet in binomial rounds: in round k the runs whose numbers
agree from bit k on exchange their entries and are merged into one, ``fan_in`` (a
power of two) at once, which is log2(fan_in) binomial rounds in one multiway merge.
A merge is Spark's sort by (digest, length, check, merged run) with one pass over
equal digests that keeps the best row at every level, until one run is left. A run
is dealt out by digest, so no task ever holds a whole run, and a digest that a third of
all rows share takes part with one entry from each run. The result goes back down
by (digest, run), so a hot digest is dealt out over its runs.

Two texts are equal when they are identical after all of space, tab, line feed,
vertical tab, form feed and carriage return are deleted. Digests are SHA-256; at every
level they are verified by the normalised length and an independent 64-bit hash of
the normalised text, which are part of every key.

Defined cases: a null text counts as empty; empty texts are all equal; the row
with the most code points of the original text stays, then the one with the
smallest id, a null id after all others; of wholly repeated rows exactly one
stays; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: What is deleted before texts are compared.
SPACES = " \t\n\x0b\x0c\r"


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.translate(text, SPACES, "").alias("norm")).select(
        "id",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.length("norm").alias("n_norm"),
        F.xxhash64("norm").alias("check"),
        F.length("text").cast("long").alias("n_chars"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, n_chars."""
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in: a power of two")
    bits = fan_in.bit_length() - 1
    rows = cut(_digests(docs, id_col, text_col).withColumns({"run": F.spark_partition_id(), "tag": F.monotonically_increasing_id()}))
    key = ["digest", "n_norm", "check"]
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "tag"))
    level = cut(rows.groupBy(*key, "run").agg(best.alias("best"), F.count("*").alias("n")))
    top, runs = level, (level.agg(F.max("run")).first()[0] or 0) + 1
    while True:
        top = top.groupBy(*key, F.shiftright("run", bits).alias("run")).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        runs = -(-runs // fan_in)
        if runs == 1:
            break
    down = level.select(*key, "run").join(top.select(*key, F.col("best").alias("top"), F.col("n").alias("group_size")), key)
    return rows.join(down, [*key, "run"]).select(
        "id",
        F.col("top.id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("top.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns kept."""
    keep = exact_groups(docs, id_col, text_col, fan_in).filter("kept").select(F.col("id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("n_chars").alias("_n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.withColumns({"_sha": F.sha2(F.translate(text, SPACES, ""), 256), "_n": F.length(text).cast("long"), "_id": F.col(id_col)})
    on = mine["_id"].eqNullSafe(keep["_id"]) & (mine["_sha"] == keep["_sha"]) & (mine["_n"] == keep["_n"])
    return mine.join(keep, on, "left_semi").dropDuplicates(["_id", "_sha", "_n"]).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return exact_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM k
"""
