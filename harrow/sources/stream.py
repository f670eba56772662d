"""A sink for streams that commits whole micro-batches: ``writeStream.format("harrow_pages")``.

Every task of a micro-batch writes Parquet files of ``batch`` rows at most under names
of its own. Commit publishes them all at once, by one small log file named after the
micro-batch; only files that a log names belong to the table. A micro-batch that
Spark repeats (a restart after a failed commit, or after a commit that Spark has
not noted) finds its log and writes nothing twice; abort removes what was written.
``read`` gives the committed rows, ``stats`` their counts from the logs alone,
``clean`` removes files of attempts that never came to a commit.

options: path (a folder that driver and executors share, reached by ``pyarrow.fs``),
batch (rows in a file, 50), name (a prefix for the logs, for several streams into one
table).
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

FORMAT = "harrow_pages"


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: file names and their rows."""

    files: list[tuple[str, int]]


class Writer(DataSourceStreamArrowWriter):
    def __init__(self, options):
        self.path, self.batch, self.run = options["path"], int(options.get("batch", 50)), options.get("name", "")

    def write(self, iterator):
        import pyarrow.parquet as pq

        files, root = _files(self.path)
        files.create_dir(f"{root}/data", recursive=True)
        held, n, out = [], 0, []

        def put(table: pa.Table) -> None:
            name = f"{uuid.uuid4().hex}.parquet"
            with files.open_output_stream(f"{root}/data/{name}") as f:
                pq.write_table(table, f, compression="zstd")
            out.append((name, table.num_rows))

        for b in iterator:
            while b.num_rows:
                part, b = b.slice(0, self.batch - n), b.slice(self.batch - n)
                held.append(part)
                n += part.num_rows
                if n == self.batch:
                    put(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            put(pa.Table.from_batches(held))
        return Written(out)

    def _log(self, root: str, batch_id: int) -> str:
        return f"{root}/log/{self.run}{batch_id:012d}.json"

    def _remove(self, messages, log: str) -> None:
        """Removes the files of ``messages`` that the log, if it is there, doesn't name."""
        from pyarrow import fs

        files, root = _files(self.path)
        named = set()
        if files.get_file_info(log).type == fs.FileType.File:
            with files.open_input_stream(log) as f:
                named = {name for name, _ in json.loads(f.read())["files"]}
        for m in messages:
            for name, _ in m.files if m else ():
                if name not in named:
                    files.delete_file(f"{root}/data/{name}")

    def commit(self, messages, batchId):
        from pyarrow import fs

        files, root = _files(self.path)
        log = self._log(root, batchId)
        if files.get_file_info(log).type == fs.FileType.File:
            self._remove(messages, log)  # this micro-batch was committed before
            return
        files.create_dir(f"{root}/log", recursive=True)
        said = {"batch": batchId, "files": [f for m in messages if m for f in m.files]}
        draft = f"{root}/log/_{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as f:
            f.write(json.dumps(said).encode())
        files.move(draft, log)

    def abort(self, messages, batchId):
        self._remove(messages, self._log(_files(self.path)[1], batchId))


class StreamedPages(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def streamWriter(self, schema, overwrite):
        return Writer(self.options)


def register(spark: SparkSession, source: type[DataSource] = StreamedPages) -> None:
    spark.dataSource.register(source)


def _logs(path: str):
    from pyarrow import fs

    files, root = _files(path)
    for x in files.get_file_info(fs.FileSelector(f"{root}/log", allow_not_found=True)):
        if x.path.endswith(".json"):
            with files.open_input_stream(x.path) as f:
                yield json.loads(f.read())


def stats(path: str) -> dict:
    """saved, batches (files of ``batch`` rows at most) and commits, from the logs."""
    logs = list(_logs(path))
    return {"saved": sum(n for x in logs for _, n in x["files"]), "batches": sum(len(x["files"]) for x in logs), "commits": len(logs)}


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all committed micro-batches."""
    names = [f"{path}/data/{name}" for x in _logs(path) for name, _ in x["files"]]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def clean(path: str) -> int:
    """Removes files that no log names (not while a stream writes); how many."""
    from pyarrow import fs

    files, root = _files(path)
    known = {name for x in _logs(path) for name, _ in x["files"]}
    gone = [x.path for x in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if x.is_file and os.path.basename(x.path) not in known]
    for p in gone:
        files.delete_file(p)
    return len(gone)
