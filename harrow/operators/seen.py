"""URLs seen so far, in files that later levels of a crawl hardly read.

Every addition is a set of Parquet files in folders by a hash of the URL, and a Bloom
filter for each folder (two bytes a URL). What is offered meets the filters of its
folder first, in one shuffle by folder: a URL that no filter knows is new, and no
stored row is read for it. Only URLs that a filter may know are looked up among
the stored ones, in the folders that they fall into, so the answer is exact.

Of stored URLs neither rows nor filters pass through the driver, only the numbers of
folders to be read, ``folders`` at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from harrow.checkpoints import cut

#: Bits for each URL, and how many of them are set.
BITS, PROBES = 16, 8


def _places(h: np.ndarray, size: int) -> np.ndarray:
    """``PROBES`` places among ``size`` bits for every hash, whose lowest bits are the same in a folder and so are mixed first."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    step = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(17)) | np.uint64(1)
    return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def bloom(hashes: np.ndarray) -> bytes:
    """A filter that knows all of ``hashes`` (unsigned)."""
    bits = np.zeros(max(64, -(-BITS * len(hashes) // 64) * 64), bool)
    bits[_places(hashes, len(bits)).ravel().astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_know(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the filter may know it: never False for one that it was made of."""
    packed = np.frombuffer(filter_, np.uint8)
    at = _places(hashes, 8 * len(packed)).astype(np.int64)
    return ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


class SeenSet:
    """path: a folder of its own that executors and driver share."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 64):
        self.spark, self.path, self.folders, self.additions, self.schema = spark, path, folders, 0, None
        #: Folders whose rows the last ``unseen`` has read.
        self.hit: list[int] = []

    def _folded(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64("url")
        return rows.withColumns({"_h": h, "_folder": F.pmod(h, F.lit(self.folders)).cast("int")})

    def unseen(self, offered: DataFrame) -> DataFrame:
        """The rows of ``offered`` (with url) whose URL has not been added."""
        if not self.additions:
            self.hit = []
            return offered
        rows = self._folded(offered)
        at = rows.columns.index("_h")

        def asked(own: pa.Table, filters: pa.Table) -> pa.Table:
            h = own.column(at).to_numpy().view(np.uint64)
            known = np.zeros(len(h), bool)
            for f in filters.column("bits").to_pylist():
                known |= may_know(f, h)
            return own.append_column("_maybe", pa.array(known))

        schema = StructType([*rows.schema.fields, StructField("_maybe", BooleanType())])
        filters = self.spark.read.schema("_folder int, bits binary").parquet(f"{self.path}/filters")
        marked = cut(rows.groupBy("_folder").cogroup(filters.groupBy("_folder")).applyInArrow(asked, schema))
        maybe = marked.filter("_maybe")
        self.hit = sorted(r["_folder"] for r in maybe.select("_folder").distinct().collect())
        stored = self.read().filter(F.col("_folder").isin(self.hit)).select("_folder", "url")  # prunes folders and columns
        fresh = marked.filter("not _maybe").unionByName(maybe.join(stored, ["_folder", "url"], "left_anti").select(*marked.columns)) if self.hit else marked
        return fresh.select(*offered.columns)

    def add(self, rows: DataFrame) -> DataFrame:
        """Adds ``rows`` (with url, not added before), all columns kept; the same rows as they are stored."""
        k, self.additions = self.additions, self.additions + 1
        where = f"{self.path}/rows/addition={k}"
        self._folded(rows).drop("_h").write.partitionBy("_folder").parquet(where)
        stored = self.spark.read.schema(rows.schema).option("basePath", where).parquet(where)
        self.schema = rows.schema

        def made(own: pa.Table) -> pa.Table:
            return pa.table({"_folder": own.column("_folder").slice(0, 1), "bits": pa.array([bloom(own.column("_h").to_numpy().view(np.uint64))], pa.binary())})

        hashes = self._folded(stored.select("url")).select("_folder", "_h")
        hashes.groupBy("_folder").applyInArrow(made, "_folder int, bits binary").write.mode("append").parquet(f"{self.path}/filters")
        return stored.select(*rows.columns)

    def read(self) -> DataFrame:
        """All rows that were added, and _folder."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{schema}, addition int, _folder int").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows").drop("addition")
