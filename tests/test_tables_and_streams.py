"""The upserting page table and the committing stream sink."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from harrow.sources import stream
from harrow.sources.table import PageTable


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/folder=*/*.parquet")}


def test_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    t = PageTable(spark, str(tmp_path / "t"), folders=8)
    pages = spark.createDataFrame([(f"http://h.test/{k}", f"old {k}", 200) for k in range(200)], "url string, title string, status int").repartition(5)
    assert t.read().count() == 0 and t.upsert(pages.limit(0)) == []
    assert t.upsert(pages) == list(range(8))
    first, before = {r["url"]: r["id"] for r in t.read().collect()}, files(t.path)
    assert len(first) == len(set(first.values())) == 200

    some = [(f"http://h.test/{k}", f"new {k}", 404) for k in (3, 4)] + [("http://h.test/3", "newer", 404)]
    batch = spark.createDataFrame(some, "url string, title string, status int").coalesce(1)
    folders = {r[0] for r in batch.select(F.pmod(F.xxhash64("url"), F.lit(8))).collect()}
    assert set(t.upsert(batch)) == folders
    after = files(t.path)
    rows = {r["url"]: r for r in t.read().collect()}
    assert {u: r["id"] for u, r in rows.items()} == first
    assert rows["http://h.test/3"]["title"] == "newer" and rows["http://h.test/4"]["status_code"] == 404 and rows["http://h.test/5"]["title"] == "old 5"
    touched = lambda p: int(p.split("folder=")[1].split("/")[0]) in folders
    assert {p: m for p, m in before.items() if not touched(p)} == {p: m for p, m in after.items() if not touched(p)}
    assert not {p for p in before if touched(p)} & set(after)

    t.upsert(spark.createDataFrame([("http://h.test/x",), (None,)], "url string"))
    ids = [r["id"] for r in t.read().collect()]
    assert len(ids) == len(set(ids)) == 202
    same = sorted(map(str, t.read().collect()))
    t.upsert(t.read())  # the table's own rows: nothing changes
    assert sorted(map(str, t.read().collect())) == same


def test_latest_row_of_a_hot_url_counts(spark, tmp_path):
    rows = spark.range(3000).select(F.lit("http://h.test/").alias("url"), F.col("id").cast("string").alias("title"), F.timestamp_seconds(F.pmod(F.col("id") * 7, F.lit(3000))).alias("crawled_at"))
    t = PageTable(spark, str(tmp_path / "t"), folders=4)
    t.upsert(rows)
    got = t.read().collect()
    assert len(got) == 1 and int(got[0]["title"]) * 7 % 3000 == 2999


SCHEMA = "url string, n long, tags array<string>"


def put(spark, path, part):
    spark.range(part * 10, part * 10 + 10).selectExpr("concat('u', id) AS url", "id AS n", "array('a', null) AS tags").coalesce(1).write.mode("append").parquet(f"{path}/in")


def run(spark, path, **options):
    q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in").writeStream.format(stream.FORMAT)
    return q.option("path", f"{path}/out").option("batch", 4).options(**options).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()


def shown(spark, path):
    return sorted(r["n"] for r in stream.read(spark, f"{path}/out", SCHEMA).collect())


class Failing(stream.Writer):
    """Fails once, between the tasks' writes and the commit."""

    def commit(self, messages, batchId):
        if not os.path.exists(f"{self.path}/failed"):
            open(f"{self.path}/failed", "w").close()
            raise RuntimeError("lost before the commit")
        super().commit(messages, batchId)


class FailingPages(stream.StreamedPages):
    def streamWriter(self, schema, overwrite):
        return Failing(self.options)


def test_nothing_is_written_twice(spark, tmp_path):
    path = str(tmp_path)
    put(spark, path, 0)
    stream.register(spark, FailingPages)
    with pytest.raises(Exception, match="lost before the commit"):
        run(spark, path).awaitTermination()
    assert shown(spark, path) == [] and glob.glob(f"{path}/out/data/*") == []  # Spark has called abort
    orphan = f"{path}/out/data/lost.parquet"
    open(orphan, "w").close()  # of a driver that died before it could
    run(spark, path).awaitTermination()  # Spark repeats the micro-batch
    assert shown(spark, path) == list(range(10))
    assert stream.clean(f"{path}/out") == 1 and not os.path.exists(orphan) and shown(spark, path) == list(range(10))

    stream.register(spark)
    put(spark, path, 1)
    run(spark, path).awaitTermination()
    assert shown(spark, path) == list(range(20)) and stream.stats(f"{path}/out") == {"saved": 20, "batches": 6, "commits": 2}
    # the commit is done, but Spark has not noted it: the micro-batch comes again
    last = max(p for p in os.listdir(f"{path}/state/commits") if p.isdigit())
    for p in (last, f".{last}.crc"):
        os.remove(f"{path}/state/commits/{p}")
    run(spark, path).awaitTermination()
    assert shown(spark, path) == list(range(20)) and stream.stats(f"{path}/out")["commits"] == 2
    assert len(glob.glob(f"{path}/out/data/*")) == 6
    assert stream.read(spark, f"{path}/none", SCHEMA).count() == 0
