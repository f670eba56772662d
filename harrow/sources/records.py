"""The stored record and its files."""

from __future__ import annotations

import codecs
import csv
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "struct<title:string,description:string,keywords:string>"
FIELDS = ["url", "title", "text", "links", "metadata", "crawled_at", "status_code", "content_type"]
DDL = f"url string, title string, text string, links array<string>, metadata {META}, crawled_at timestamp, status_code int, content_type string"


def to_record(pages: DataFrame) -> DataFrame:
    """The eight stored fields; what is absent is filled, ``crawled_at`` with now."""
    have = set(pages.columns)
    pick = lambda c, default: F.coalesce(F.col(c), default) if c in have else default
    empty = F.struct(*[F.lit("").alias(c) for c in ("title", "description", "keywords")])
    status = "status_code" if "status_code" in have else "status"
    return pages.select(
        pick("url", F.lit("")).alias("url"), pick("title", F.lit("")).alias("title"), pick("text", F.lit("")).alias("text"),
        pick("links", F.array().cast("array<string>")).alias("links"), pick("metadata", empty).cast(META).alias("metadata"),
        pick("crawled_at", F.current_timestamp()).alias("crawled_at"),
        (F.col(status) if status in have else F.lit(None)).cast("int").alias("status_code"),
        (F.col("content_type") if "content_type" in have else F.lit(None)).cast("string").alias("content_type"),
    )


def flat(records: DataFrame) -> DataFrame:
    """Records as text cells: JSON for lists and structs, ISO time, "" for null."""
    js = {"ignoreNullFields": "false"}
    return records.select("url", "title", "text", F.to_json("links", js).alias("links"), F.to_json("metadata", js).alias("metadata"), F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("crawled_at"), F.col("status_code").cast("string").alias("status_code"), "content_type")


def unflat(rows: DataFrame) -> DataFrame:
    """The reverse of ``flat``; an empty cell is null where the type is not text."""
    return rows.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"), F.from_json("links", "array<string>").alias("links"), F.from_json("metadata", META).alias("metadata"), F.to_timestamp("crawled_at").alias("crawled_at"), F.expr("try_cast(status_code as int)").alias("status_code"), "content_type")


def write_jsonl(records: DataFrame, path: str, mode: str = "append") -> None:
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or files of one JSON array each, told apart by the first character that is not blank."""
    head = spark.read.text(path).filter(F.col("value").rlike(r"\S")).select(F.regexp_extract("value", r"^\s*(\S)", 1)).limit(1).collect()  # a line may be a whole array
    array = bool(head) and head[0][0].startswith("[")
    return spark.read.schema(DDL).option("multiLine", array).json(path)


def write_json_array(records: DataFrame, path: str) -> None:
    """One file with a pretty array, rows in their order; streams through the driver, for small results."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        first = True
        for r in _json_rows(records):
            out.write(("\n" if first else ",\n") + json.dumps(r, ensure_ascii=False, indent=2))
            first = False
        out.write("]" if first else "\n]")


def write_json_arrays(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of files, one array in each, rows in their order; each is written by a task and nothing passes through the driver. A task without rows may leave an empty file."""
    js = {"ignoreNullFields": "false", "pretty": "true"}
    fields = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c) if c == "crawled_at" else F.col(c) for c in records.columns]

    def arrays(batches):
        before = "["
        for b in batches:
            lines = []
            for x in b.column("value"):  # a comma is written once it is known that a row follows
                lines.append(before)
                before = x.as_py() + ","
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        end = [before if before == "[" else before[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([*end, "]"], pa.string())], ["value"])

    records.select(F.to_json(F.struct(*fields), js).alias("value")).mapInArrow(arrays, "value string").write.mode(mode).text(path)


def _json_rows(records: DataFrame):
    for r in records.withColumn("crawled_at", F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")).toLocalIterator():
        yield r.asDict(recursive=True)


CSV = {"header": "true", "multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_csv(records: DataFrame, path: str, mode: str = "overwrite", delimiter: str = ",", encoding: str = "utf-8") -> None:
    """CSV files, with "utf-8-sig" each with a byte order mark before its header; encodings that Spark's writer has not are streamed by the driver to one file."""
    rows = flat(records)
    if encoding.lower() == "utf-8-sig":
        rows, encoding = rows.withColumnRenamed("url", "\ufeffurl"), "utf-8"
    if encoding.lower() in ("utf-8", "utf8"):
        rows.fillna("").write.mode(mode).options(**CSV, sep=delimiter, emptyValue="").csv(path)
        return
    codecs.lookup(encoding)
    with open(path, "w", encoding=encoding, errors="xmlcharrefreplace", newline="") as out:
        writer = csv.writer(out, delimiter=delimiter)
        writer.writerow(FIELDS)
        for r in rows.toLocalIterator():
            writer.writerow(["" if x is None else x for x in r])


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """CSV files in any encoding that Java has, each read by a task of its own."""
    schema, options = ", ".join(f"{c} string" for c in FIELDS), dict(CSV)
    if encoding.lower() not in ("utf-8", "utf8", "utf-8-sig"):  # the header, mark and all, is not read
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # code pages as well
        options["encoding"] = codecs.lookup(encoding).name
    return unflat(spark.read.schema(schema).options(**options, sep=delimiter).csv(path))
