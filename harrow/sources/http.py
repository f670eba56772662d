"""Pages over HTTP as a data source: ``spark.read.format("harrow_http")``.

``deal`` writes the wanted URLs once, as Parquet in folders by a hash of the domain
and in the order of their ranks. The source then deals whole folders to its tasks
by size, largest first, so that uneven domains do not leave a task with most of
the work; only sizes of folders reach the driver, never URLs. A filter on domain or
URL is pushed down: folders that cannot hold it are not read, and no other URL is
fetched. A task merges its folders by rank, so URLs start in the order of the level.

Limits, retries, rate slots and breakers are those of ``harrow.operators.fetch``: a
domain lies in one folder, hence in one task. The folder must be one that executors
and driver share (``pyarrow.fs`` reads it).
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from harrow.functions import urls
from harrow.operators import fetch

#: Folders, if ``deal`` is not told otherwise.
FOLDERS = 256
_COLUMNS = ["domain", "url", "state", "delay", "rank"]


def deal(wanted: DataFrame, path: str, url_col: str = "url", states: DataFrame | None = None, folders: int = FOLDERS) -> None:
    """Writes what is wanted (url, and rank or crawl_delay if there are) for the source to read."""
    rows = fetch.wanted_rows(wanted, url_col, states).withColumn("folder", F.pmod(F.crc32("domain"), F.lit(folders)).cast("int"))
    rows.repartition("folder").sortWithinPartitions("folder", "rank", "url").write.mode("overwrite").partitionBy("folder").option("compression", "zstd").parquet(f"{path}/n={folders}")


@dataclass
class _Share(InputPartition):
    folders: list[str]
    tasks: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, tasks: int, options: fetch.FetchOptions, get: Callable):
        self.path, self.tasks, self.options, self.get = path, tasks, options, get
        self.domains: set[str] | None = None
        self.urls: set[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute not in (("domain",), ("url",)):
                yield f
            elif f.attribute == ("domain",):
                self.domains = values if self.domains is None else self.domains & values
            else:
                self.urls = values if self.urls is None else self.urls & values
                of = {domain_of(u) for u in values}
                self.domains = of if self.domains is None else self.domains & of

    def partitions(self):
        files, root = _files(self.path)
        own = [x for x in files.get_file_info(_selector(root)) if x.is_file and x.path.endswith(".parquet")]
        sizes: dict[str, int] = {}
        for x in own:
            folder = os.path.dirname(x.path)
            sizes[folder] = sizes.get(folder, 0) + x.size
        if self.domains is not None:
            sizes = {p: n for p, n in sizes.items() if any(_number(d, p) for d in self.domains)}
        tasks = max(1, min(self.tasks, len(sizes)))
        heap = [(0, k, []) for k in range(tasks)]
        for n, folder in sorted(((n, p) for p, n in sizes.items()), reverse=True):
            total, k, held = heapq.heappop(heap)
            heapq.heappush(heap, (total + n, k, [*held, folder]))
        return [_Share(held, tasks) for _, _, held in sorted(heap, key=lambda x: x[1]) if held] or [_Share([], 1)]

    def read(self, partition):
        rows = heapq.merge(*(self._rows(p) for p in partition.folders))
        wanted = ((domain, url, state, delay) for _, url, domain, state, delay in rows)
        for got in fetch.fetched_rows(wanted, self.options, self.get, fetch.fetch_one, partition.tasks, text=True):
            got["attempts"] = [tuple(a[k] for k in ("attempt", "status", "error", "delay")) for a in got["attempts"]]
            got["state"] = tuple(got["state"].get(k) for k in fetch.STATE_FIELDS)
            yield tuple(got[c] for c in fetch.RESULT_FIELDS)

    def _rows(self, folder: str):
        """(rank, url, domain, state, delay) of a folder in its order, a batch in memory at a time."""
        import pyarrow.dataset as ds

        files, _ = _files(self.path)
        for b in ds.dataset(folder, format="parquet", filesystem=files, partitioning=None).to_batches(columns=_COLUMNS, batch_size=1024):
            for r in b.to_pylist():
                if (self.domains is None or r["domain"] in self.domains) and (self.urls is None or r["url"] in self.urls):
                    yield r["rank"], r["url"], r["domain"], r["state"], r["delay"]


def domain_of(url: str) -> str:
    """What ``urls.domain_of`` says of a URL."""
    return (re.match(urls.SPLIT, url).group(2) or "").lower()


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root, recursive=True, allow_not_found=True)


def _number(domain: str, folder: str) -> bool:
    """Whether a folder (``.../n=256/folder=17``) is that of a domain."""
    n, k = re.search(r"/n=([0-9]+)/folder=([0-9]+)$", folder).groups()
    return zlib.crc32(domain.encode()) % int(n) == int(k)


def register(spark: SparkSession, options: fetch.FetchOptions | None = None, get: Callable = fetch.http_get, name: str = "harrow_http") -> None:
    """Registers the source under ``name`` with these settings and this fetcher; its reader options are path and tasks."""
    settings, of_name = options or fetch.FetchOptions(), name
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class HttpPages(DataSource):
        @classmethod
        def name(cls):
            return of_name

        def schema(self):
            return fetch.RESULT

        def reader(self, schema):
            return _Reader(self.options["path"], int(self.options.get("tasks", settings.max_concurrent)), settings, get)

    spark.dataSource.register(HttpPages)
