"""Stored pages as a table with an upsert by URL that rewrites only what it touches.

Rows lie in folders by a hash of the URL. An upsert reads, joins and overwrites the
folders that its URLs fall into and no other (Spark's dynamic partition overwrite);
the number of folders, at most ``folders``, is all that reaches the driver. Of several
rows of a URL the last counts, and a row that is there keeps its id. New ids are
numbered inside each folder: folder + folders * k.

The merged rows are in the checkpoint folder before anything is overwritten, so a
lost executor costs a task; doing an upsert again changes nothing.

Defined cases: a null URL is the empty one; of equal times the later row of the batch
counts; an empty batch writes nothing; other columns than the stored ones are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.checkpoints import cut

from .records import DDL, FIELDS, to_record

SCHEMA = f"id long, {DDL}, folder int"


class PageTable:
    """folders: so many that one of them, which one task writes, stays a file of moderate size."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 64):
        self.spark, self.path, self.folders = spark, path, folders

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def read(self) -> DataFrame:
        """id and the stored fields."""
        return self._stored().drop("folder")

    def upsert(self, pages: DataFrame) -> list[int]:
        """Inserts or replaces the rows of ``pages``; the folders that were written."""
        rows = to_record(pages).withColumn("_place", F.monotonically_increasing_id())
        fields = F.struct(*[F.col(c) for c in FIELDS[1:]])
        new = rows.groupBy("url").agg(F.max_by(fields, F.struct("crawled_at", "_place")).alias("new"))
        new = cut(new.withColumn("folder", F.pmod(F.xxhash64("url"), F.lit(self.folders)).cast("int")))
        touched = sorted(r["folder"] for r in new.select("folder").distinct().collect())
        if not touched:
            return []
        old = self._stored().filter(F.col("folder").isin(touched))  # prunes folders
        old = old.select("folder", "url", "id", F.struct(*FIELDS[1:]).alias("old"))
        both = old.join(new, ["folder", "url"], "full")
        here = Window.partitionBy("folder")
        last = F.coalesce(F.max(F.floor(F.col("id") / self.folders)).over(here), F.lit(-1))
        k = last + F.row_number().over(here.orderBy(F.col("id").isNotNull(), "new.crawled_at", "url"))
        merged = both.select(
            F.coalesce("id", F.col("folder") + self.folders * k).cast("long").alias("id"),
            "url",
            *[F.coalesce(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")), F.when(F.col("new").isNull(), F.col(f"old.{c}"))).alias(c) for c in FIELDS[1:]],
            "folder",
        )
        merged = cut(merged)
        merged.repartition("folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(self.path)
        return touched
