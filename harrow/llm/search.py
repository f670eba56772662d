"""Ranked lexical search: document-at-a-time over compressed postings, shard by shard.

Index. Every input partition is cut into shards of about ``SHARD`` words where it
lies; no text is shuffled. A shard numbers its documents in the order of their ids
and holds, for each term, its postings in that order: gaps of document numbers and
term frequencies as variable-length integers. It also holds the documents' ids and
lengths, and how many documents and terms it has. Sums over the shards give the
statistics of the whole table.

Search. Queries are broadcast in blocks of at most ``max_query_words`` words. In
each shard the postings of a query's terms are merged by a heap of k lists, keyed by
the next document of each: a step takes from the lists in the heap's order all that
lies up to the nearest end of a block of postings, so every document up to there
has its whole score before the next is looked at. The best ``k`` are kept in a
bounded heap by score, then id, which goes on through all shards of a task; the
tasks' results are merged by item.

Scores are 64-bit integers; only a term's weight is a double before it is rounded
down. With N documents that have a term, L terms in all, n in one document, df
documents that hold a term and tf occurrences in one of them, the weight w is
floor(1000 ln((2N + 2) / (2 df + 1))), m is 75 + 25 n N div L, and a document scores
w (10^9 tf div (1000 tf + 12 m)) for each of the query's terms, repeats included.

Where the queries of a search are known and have at most ``max_query_words`` words,
``build`` may be given their terms, and keeps the postings of these only; all
documents count in the statistics either way.

Defined cases: null and empty texts, and texts without a term, are in no list and
count for nothing; a null or empty query has no result; repeated queries each have
theirs; repeated rows are ranked each; of equal scores the smaller id comes first, a
null id last; an empty table on either side gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, stretches, table

#: Words that a shard holds about, and postings in a block.
SHARD, BLOCK = 1 << 22, 4096
_SIGNS = bytes(range(0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
#: A-Z in lower case, and a blank for what is in no term.
_FOLD = bytes.maketrans(bytes(range(0x41, 0x5B)) + _SIGNS, bytes(range(0x61, 0x7B)) + b" " * len(_SIGNS))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text with repeats, in lists of bounded size."""
    for part in stretches(text or ""):
        yield part.encode("utf-8", "replace").translate(_FOLD).split()


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers in seven bits a byte, lowest first, and where each one ends."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(9):
        more = size > k
        if not more.any():
            break
        out[(ends - size)[more] + k] = (v[more] >> np.uint64(7 * k)).astype(np.uint8) & 127 | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out, ends


def read_varints(data: bytes) -> np.ndarray:
    """What ``varints`` has written."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    starts = np.r_[0, np.flatnonzero(b < 128)[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.r_[starts, len(b)]))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


class _Numbers(dict):
    """A number for every term, in order of appearance."""

    def __missing__(self, term: bytes) -> int:
        got = self[term] = len(self)
        return got


def _shard(ids: list, lengths: list[int], tokens: list[np.ndarray], numbers: dict[bytes, int], id_type) -> pa.RecordBatch:
    """One shard as one row."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    key = np.concatenate([t.astype(np.int64) << 32 | place[k] for k, t in enumerate(tokens)]) if tokens else np.zeros(0, np.int64)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key >> 32, key & 0xFFFFFFFF
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    gap = np.diff(doc, prepend=0)
    gap[start] = doc[start]
    data, ends = varints(np.stack([gap, tf], axis=1).ravel())
    bounds = np.r_[0, ends[2 * np.r_[start[1:], len(term)] - 1]] if len(start) else np.zeros(1, np.int64)
    raw = data.tobytes()
    names = [t.decode() for t in numbers]
    cells = {
        "n_docs": pa.array([len(ids)], pa.int64()),
        "n_terms": pa.array([sum(lengths)], pa.int64()),
        "ids": pa.array([[ids[k] for k in order]], pa.list_(id_type)),
        "lengths": pa.array([varints(np.array([lengths[k] for k in order], np.int64))[0].tobytes()], pa.binary()),
        "terms": pa.array([[names[t] for t in term[start].tolist()]], pa.list_(pa.string())),
        "counts": pa.array([np.diff(np.r_[start, len(term)]).tolist()], pa.list_(pa.int64())),
        "postings": pa.array([[raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]], pa.list_(pa.binary())),
    }
    return pa.RecordBatch.from_pydict(cells)


def build(docs: DataFrame, id_col="doc_id", text_col="text", only: set[bytes] | None = None) -> DataFrame:
    """The index of ``docs``, a row for each shard; of ``only`` these terms if given. Kept in the checkpoint folder."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = rows.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(sorted(only))} if only is not None else None)

    def run(batches):
        given, id_type = known.value, None
        numbers = _Numbers() if given is None else given
        ids, lengths, tokens, held = [], [], [], 0
        for b in batches:
            id_type = b.schema.field("id").type
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                n, own = 0, []
                for part in terms(text.as_py()):
                    n += len(part)
                    found = np.fromiter(map(numbers.__getitem__, part) if given is None else map(numbers.get, part, repeat(-1)), np.int32, len(part))
                    own.append(found[found >= 0])
                if not n:
                    continue
                ids.append(i)
                lengths.append(n)
                tokens.append(np.concatenate(own))
                held += n
                if held >= SHARD:
                    yield _shard(ids, lengths, tokens, numbers, id_type)
                    ids, lengths, tokens, held = [], [], [], 0
                    numbers = _Numbers() if given is None else given
        if ids:
            yield _shard(ids, lengths, tokens, numbers, id_type)

    kind = rows.schema["id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"n_docs long, n_terms long, ids array<{kind}>, lengths binary, terms array<string>, counts array<long>, postings array<binary>"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Shard:
    """A shard's postings as (document number, contribution to a score), read when they are first asked for."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, weights: dict[str, int]):
        self.ids, self.weights = row["ids"], weights
        self.m12 = 12 * (100 - 25 + 25 * read_varints(row["lengths"]) * n_docs // n_terms)
        self.at = {t: k for k, t in enumerate(row["terms"]) if t in weights}
        self.postings, self.read = row["postings"], {}

    def list_of(self, term: str) -> tuple[np.ndarray, np.ndarray] | None:
        if term not in self.at:
            return None
        if term not in self.read:
            pairs = read_varints(self.postings[self.at[term]].as_py()).reshape(-1, 2)
            doc, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            self.read[term] = doc, self.weights[term] * (1_000_000_000 * tf // (1000 * tf + self.m12[doc]))
        return self.read[term]

    def best(self, query: dict[str, int], k: int) -> list[tuple[int, int]]:
        """(score, document number) of the ``k`` best: documents are finished in order, up to the nearest end of a block at a time."""
        lists = [(*found, times) for t, times in query.items() if (found := self.list_of(t)) is not None]
        heap = [(int(doc[0]), j, 0) for j, (doc, _, _) in enumerate(lists)]  # next document, list, place in it
        heapq.heapify(heap)
        ends = [int(doc[min(BLOCK, len(doc)) - 1]) for doc, _, _ in lists]  # of each list's block
        out: list[tuple[int, int]] = []  # a heap whose first is the worst: score, then -document number
        while heap:
            low = heap[0][0]
            high = min(ends[j] for _, j, _ in heap)
            scores = np.zeros(high - low + 1, np.int64)
            while heap and heap[0][0] <= high:
                _, j, at = heap[0]
                doc, part, times = lists[j]
                stop = int(np.searchsorted(doc, high, "right"))
                scores[doc[at:stop] - low] += times * part[at:stop]
                if stop < len(doc):
                    heapq.heapreplace(heap, (int(doc[stop]), j, stop))
                    if ends[j] <= high:
                        ends[j] = int(doc[min(stop + BLOCK, len(doc)) - 1])
                else:
                    heapq.heappop(heap)
            found = np.flatnonzero(scores > (out[0][0] if len(out) == k else 0))
            if len(found) > k:  # of equal scores the first documents
                found = found[np.argsort(-scores[found], kind="stable")[:k]]
            for s, d in zip(scores[found].tolist(), (found + low).tolist(), strict=True):
                if len(out) < k:
                    heapq.heappush(out, (s, -d))
                else:
                    heapq.heappushpop(out, (s, -d))
        return [(s, -d) for s, d in out]


def _rank(entry: tuple) -> tuple:
    score, i = entry
    return -score, i is None, i if i is not None else 0


def _blocks(queries: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[object, Counter]]]:
    """The queries in blocks of at most ``most`` words (a longer query is a block by itself)."""
    held, n = [], 0
    for r in queries.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        count: Counter = Counter()
        for part in terms(r["t"]):
            count.update(part)
        size = count.total()
        if held and n + size > most:
            yield held
            held, n = [], 0
        if size:
            held.append((r["i"], Counter({t.decode(): c for t, c in count.items()})))
            n += size
    if held:
        yield held


def search(index: DataFrame, queries: DataFrame, k: int = 20, item_col="item_id", text_col="text", max_query_words: int = 1_000_000) -> DataFrame:
    """The ``k`` best documents of each query with a score above 0: item_id, rank, id, score."""
    spark = index.sparkSession
    item_type, id_type = queries.schema[item_col].dataType, index.schema["ids"].dataType.elementType
    schema = f"query long, item_id {item_type.simpleString()}, id {id_type.simpleString()}, score long"
    item_arrow, id_arrow = to_arrow_type(item_type), to_arrow_type(id_type)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    found, base, many = spark.createDataFrame([], schema), 0, False
    for block in _blocks(queries, item_col, text_col, max_query_words):
        wanted = {t for _, q in block for t in q}  # bounded by max_query_words
        asked = spark.createDataFrame(pa.table({"term": sorted(wanted)}))
        counts = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df")).join(asked, "term")
        weights = {r["term"]: weight(n_docs, r["df"]) for r in counts.toLocalIterator()}
        held = spark.sparkContext.broadcast((block, weights))

        def run(batches, held=held, base=base):
            block, weights = held.value
            best: list[list[tuple[int, object]]] = [[] for _ in block]
            for b in batches:
                for r in range(len(b)):
                    row = {c: b.column(c)[r] for c in ("ids", "lengths", "terms", "postings")}
                    shard = _Shard({"ids": row["ids"].as_py(), "lengths": row["lengths"].as_py(), "terms": row["terms"].as_py(), "postings": row["postings"].values}, n_docs, n_terms, weights)
                    for q, (_, query) in enumerate(block):
                        own = [(s, shard.ids[d]) for s, d in shard.best(query, k)]
                        best[q] = heapq.nsmallest(k, best[q] + own, key=_rank)
            rows = [(base + q, block[q][0], i, s) for q, top in enumerate(best) for s, i in top]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), item_arrow, id_arrow, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query", "item_id", "id", "score"])

        one = index.mapInArrow(run, schema)
        if many:  # more blocks: each is searched and let go
            one = cut(one)
            held.unpersist()
        found, base, many = found.unionAll(one), base + len(block), True
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "id", "score")


def query_terms(queries: DataFrame, text_col="text", most: int = 1_000_000) -> set[bytes] | None:
    """The distinct terms of all queries, or None if these have more than ``most`` words."""
    out: set[bytes] = set()
    n = 0
    for r in queries.select(F.col(text_col).alias("t")).toLocalIterator():
        for part in terms(r["t"]):
            n += len(part)
            out.update(part)
        if n > most:
            return None
    return out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    index = build(table(spark, sf_dir, "documents"), only=query_terms(items))
    return search(index, items).withColumnRenamed("id", "doc_id").select("item_id", "rank", "doc_id", "score")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, {_AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, big_n),
score AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l)))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), s
  GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 20
"""
