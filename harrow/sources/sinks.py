"""Sinks by batch: retries, counts, fan-out. A sink never raises for a failed write; it counts."""

from __future__ import annotations

import json
import logging
import os
import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.checkpoints import cut, cut_counted
from harrow.operators.frontier import rank_rows

from . import records as rec
from .sqlite import write_sqlite

# Storage types and what file names mean, as the settings file has them.
TYPES = ("none", "json", "jsonl", "csv", "sqlite")
BY_EXTENSION = {".json": "json", ".jsonl": "jsonl", ".csv": "csv", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite"}


class Sink:
    """Writes DataFrames in batches of ``batch_size`` rows. Subclasses give ``_write`` and, if need be, ``_close``.

    All whole batches of what has been saved are one distributed write; the rest,
    less than a batch, waits in the checkpoint folder for more or for ``flush``.
    """

    #: Batches that may be lost in a row before the rest of a save is not tried any more.
    GIVE_UP = 8
    _in_row = 0

    def __init__(self, path: str | None = None, batch_size: int = 50, retries: int = 2, delay: float = 0.2):
        self.path, self.batch_size, self.retries, self.delay = path, batch_size, retries, delay
        self.saved = self.failed = self.batches = self.write_errors = self.buffered = 0
        self.closed = False
        self._held: DataFrame | None = None

    def _write(self, batch: DataFrame) -> None:
        raise NotImplementedError

    def _close(self) -> None:
        pass

    def save(self, pages: DataFrame) -> bool:
        """Takes what is no failure; False if a write was wanted and failed."""
        fresh = rec.to_record(pages.filter("error is null") if "error" in pages.columns else pages)
        rows, n = cut_counted(fresh if self._held is None else self._held.unionByName(fresh))
        whole = n // self.batch_size * self.batch_size
        if not whole:
            self._held, self.buffered = rows, n
            return True
        if whole == n == self.batch_size:
            self._held, self.buffered = None, 0
            return self._tried(rows, n)
        ranked = rank_rows(rows, ["crawled_at", "url"], "_rank")
        self._held, self.buffered = (cut(ranked.filter(F.col("_rank") > whole).drop("_rank")), n - whole) if whole < n else (None, 0)
        return self._parted(ranked, 1, whole)

    def flush(self) -> bool:
        """Writes what waits."""
        held, n = self._held, self.buffered
        self._held, self.buffered = None, 0
        return self._tried(held, n) if n else True

    def _tried(self, rows: DataFrame, n: int, lost: bool = True) -> bool:
        """One write with its retries. lost: what fails for good is lost, and not to be tried again in parts."""
        for k in range(self.retries + 1 if lost else 1):
            try:
                self._write(rows)
                self.saved, self.batches = self.saved + n, self.batches + -(-n // self.batch_size)
                self._in_row = 0
                return True
            except Exception:
                self.write_errors += 1
                if lost and k < self.retries:
                    time.sleep(self.delay * 2**k)
        if lost:
            self.failed += n
            self._in_row += 1
        return False

    def _parted(self, ranked: DataFrame, first: int, last: int) -> bool:
        """Whole batches of ranks ``first`` to ``last`` in one write; if that fails, by halves, so that a bad row costs its batch alone.

        After ``GIVE_UP`` lost batches in a row the rest is lost untried: then the place itself is bad.
        """
        n = last - first + 1
        rows = ranked.filter(F.col("_rank").between(first, last)).drop("_rank")
        if n <= self.batch_size:
            return self._tried(rows, n)
        if self._in_row >= self.GIVE_UP:
            self.failed += n
            return False
        if self._tried(rows, n, lost=False):
            return True
        half = first + -(-n // self.batch_size) // 2 * self.batch_size - 1
        return all([self._parted(ranked, first, half), self._parted(ranked, half + 1, last)])

    def close(self) -> None:
        """Writes what waits and closes, once; what goes wrong then is only logged."""
        if self.closed:
            return
        self.flush()
        try:
            self._close()
        except Exception:
            logging.getLogger("harrow").exception("closing %s", type(self).__name__)
        self.closed = True

    def stats(self) -> dict:
        return {"saved": self.saved, "failed": self.failed, "batches": self.batches, "write_errors": self.write_errors, "buffered": self.buffered}


class JsonLines(Sink):
    def _write(self, batch):
        rec.write_jsonl(batch, self.path)


class JsonArray(Sink):
    """Batches go to JSON lines beside the file; closing writes the one array (``[]`` for none)."""

    def _write(self, batch):
        rec.write_jsonl(batch, self.path + ".parts")

    def _close(self):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        if Path(self.path + ".parts").exists():
            rec.write_json_array(rec.read_json(spark, self.path + ".parts"), self.path)
            shutil.rmtree(self.path + ".parts")
        else:
            Path(self.path).write_text("[]", encoding="utf-8")


class Csv(Sink):
    def __init__(self, path, delimiter=",", encoding="utf-8", **more):
        super().__init__(path, **more)
        self.delimiter, self.encoding = delimiter, encoding

    def _write(self, batch):
        rec.write_csv(batch, self.path, mode="append", delimiter=self.delimiter, encoding=self.encoding)


class Sqlite(Sink):
    def _write(self, batch):
        write_sqlite(batch, self.path, self.batch_size, retries=0)


class Multi(Sink):
    """The same batch to several sinks; one that fails does not keep the others from theirs."""

    def __init__(self, *sinks: Sink):
        super().__init__()
        self.sinks = sinks

    def save(self, pages: DataFrame) -> bool:
        held = pages.persist()
        try:
            return all([s.save(held) for s in self.sinks])
        finally:
            held.unpersist()

    def flush(self):
        return all([s.flush() for s in self.sinks])

    def close(self):
        for s in self.sinks:
            s.close()

    def stats(self):
        return {"sinks": [s.stats() for s in self.sinks]}


def type_of(path: str) -> str:
    ext = os.path.splitext(path)[1].lower()
    if ext not in BY_EXTENSION:
        raise ValueError(f"no storage type for extension {ext!r}; known: {', '.join(sorted(BY_EXTENSION))}")
    return BY_EXTENSION[ext]


def make_sink(kind: str, path: str | None, batch_size: int = 50, overwrite: bool = False) -> Sink | None:
    """The sink of a storage type; ``overwrite`` removes what is there, once."""
    if kind == "none":
        return None
    if kind not in TYPES or not path:
        raise ValueError(f"storage type {kind!r} with path {path!r}")
    if overwrite:
        for p in (Path(path), Path(path + ".parts")):
            shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)
    if kind == "csv":
        return Csv(path, encoding="utf-8-sig", batch_size=batch_size)
    return {"json": JsonArray, "jsonl": JsonLines, "sqlite": Sqlite}[kind](path, batch_size=batch_size)


def write_stats_json(stats: dict, path: str, tables: dict[str, DataFrame] | None = None, **extra) -> None:
    """One JSON object. tables: lists that come row by row from Spark, whole, in place of those of these names."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    tables = tables or {}
    said = {k: v for k, v in (stats | extra).items() if k not in tables}
    text = json.dumps(said, ensure_ascii=False, indent=2, default=str)
    if not tables:
        Path(path).write_text(text, encoding="utf-8")
        return
    with open(path, "w", encoding="utf-8") as out:
        out.write(text[:-1].rstrip() + "," * bool(said))
        for k, (name, rows) in enumerate(tables.items()):
            out.write("," * bool(k) + f"\n  {json.dumps(name)}: [")
            one = len(rows.columns) == 1
            for j, r in enumerate(rows.toLocalIterator()):
                cell = r[0] if one else r.asDict(recursive=True)
                out.write("," * bool(j) + "\n    " + json.dumps(cell, ensure_ascii=False, default=str))
            out.write("\n  ]")
        out.write("\n}")


def for_each_batch(sink: Sink, hook: Callable[[DataFrame], None] | None = None):
    """A ``foreachBatch`` function: saves the batch, then calls ``hook``, whose exceptions are swallowed."""

    def run(batch: DataFrame, _: int) -> None:
        sink.save(batch)
        if hook is not None:
            try:
                hook(batch)
            except Exception:
                pass

    return run
