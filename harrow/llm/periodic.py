"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, of ``exponent``
periods and ``shortest`` words at least, that no neighbouring word extends. Runs are
found in three phases, on whole texts, in the task that holds them:

1. The Lempel-Ziv blocks of a sequence give a leftmost-covering set of squares: for
   every block boundary and every distance, common extensions to both sides tell the
   periodic stretch around it. Distances whose stretch is the same as a smaller
   one's are not primitive, and a stretch below the shortest run is of no interest:
   the leftmost of the equal stretches of any run is met by a boundary itself.
2. A square is the place in the suffix tree where its word ends. From each place the
   walk goes on over suffix links to the square that starts one word later, as long as
   the tree has it, until it meets a place that was marked before: the vocabulary
   of squares is complete.
3. All leaves below a marked place are occurrences of its square. Occurrences of one
   period that start at consecutive words merge into one run.

The suffix tree is that of the suffix array by prefix doubling, whose names of all
stretches of 1, 2, 4, ... words also answer common extensions in both directions.

Not every word needs a tree: inside a run every three neighbouring words occur three
times at least in the text, so only stretches of four or more such neighbours go in,
many of them at once, between separators that equal nothing. Triples are counted in
hashed buckets, which can only let more in.

Of each run the first period stays; a word is dropped if any run holds it after that
run's first q words.

Memory is linear in the longest such stretch of one text (about 200 bytes a word) or
in ``CHUNK`` words, whichever is more; nothing is shuffled.

Defined cases: null and empty texts have no words and no runs; ids may be null or
repeated and every row has its own result; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stretches, table

#: Words that are looked at together, words of one tree (a longer stretch has its own), and bits of the buckets that count triples.
CHUNK, TREE, BITS = 1 << 20, 1 << 16, 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


class Names:
    """Names of all stretches of 2^l words of a sequence whose last word is unique, and its suffix array."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        name = np.unique(seq, return_inverse=True)[1] + 1
        self.levels = [np.append(name, 0).astype(np.int32)]
        while (most := int(self.levels[-1].max())) < n:
            step = 1 << len(self.levels) - 1
            last = self.levels[-1].astype(np.int64)
            key = last[:n] * (most + 1)
            if step < n:
                key[: n - step] += last[step:n]
            self.levels.append(np.append(np.unique(key, return_inverse=True)[1] + 1, 0).astype(np.int32))
        self.n, self.rank = n, self.levels[-1][:n] - 1
        self.order = np.empty(n, np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from ``i`` and from ``j`` on (i and j differ)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name = self.levels[k]
            a, b = np.minimum(i + out, self.n), np.minimum(j + out, self.n)
            out += ((name[a] == name[b]) & (a < self.n) & (b < self.n)).astype(np.int64) << k
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before ``i`` and before ``j``."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, step = self.levels[k], 1 << k
            a, b = i - out - step, j - out - step
            out += ((name[np.maximum(a, 0)] == name[np.maximum(b, 0)]) & (a >= 0) & (b >= 0)).astype(np.int64) << k
        return out


class Tree:
    """The suffix tree: leaf r is the suffix of rank r, inner nodes follow from n on."""

    def __init__(self, names: Names):
        n, order = names.n, names.order
        shared = np.zeros(n + 1, np.int64)
        if n > 1:
            shared[1:n] = names.ahead(order[:-1].astype(np.int64), order[1:].astype(np.int64))
        self.n, self.names = n, names
        self.order, self.rank = array("i", order.tobytes()), array("i", names.rank.tobytes())
        self.parent, self.depth = array("i", bytes(4 * n)), array("i", (n - order).astype(np.int32).tobytes())
        self.left, self.right, self.first = array("i", range(n)), array("i", range(n)), array("i", self.order)
        self.root = self._inner(0, 0)
        self._fill(shared.tolist())
        self.links: dict[int, int] = {}

    def _inner(self, depth: int, left: int) -> int:
        for into, x in ((self.parent, -1), (self.depth, depth), (self.left, left), (self.right, self.n - 1), (self.first, self.n)):
            into.append(x)
        return len(self.parent) - 1

    def _fill(self, shared: list[int]) -> None:
        parent, depth, first = self.parent, self.depth, self.first
        open_ = [self.root]
        for r in range(1, self.n + 1):
            common = shared[r]  # 0 at the end, which closes all but the root
            node = r - 1
            while depth[open_[-1]] > common:
                inner = open_.pop()
                self.right[inner] = r - 1
                parent[node] = inner
                first[inner] = min(first[inner], first[node])
                node = inner
            if depth[open_[-1]] < common:
                open_.append(self._inner(common, self.left[node]))
            inner = open_[-1]
            parent[node] = inner
            first[inner] = min(first[inner], first[node])

    def up(self, node: int, depth: int) -> int:
        """The highest node on the way to ``node`` that is ``depth`` words deep or more."""
        above = self.parent[node]
        while above >= 0 and self.depth[above] >= depth:
            node, above = above, self.parent[above]
        return node

    def link(self, node: int) -> int:
        """The node of the same words without the first."""
        if node < self.n:
            return self.rank[self.order[node] + 1]
        if node not in self.links:
            self.links[node] = self.up(self.rank[self.order[self.left[node]] + 1], self.depth[node] - 1)
        return self.links[node]

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks: each is the longest stretch that also starts earlier, or one new word."""
        starts, at = [], 0
        while at < self.n:
            starts.append(at)
            node = self.rank[at]
            while node != self.root and self.first[node] >= at:
                node = self.parent[node]
            at += max(1, self.depth[node] if node != self.root else 1)
        return starts


def _covering(names: Names, starts: list[int], exponent: int, shortest: int) -> list[tuple[int, int]]:
    """(start, period) of a periodic stretch for each that a block boundary meets, of smallest period."""
    h = np.array([*starts, names.n, names.n], np.int64)
    here, then = np.diff(h)[:-1], np.diff(h)[1:]

    def distances(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """1, 2, ... for each block (a run holds ``exponent`` of them), and the block's number."""
        many = np.minimum(many, names.n // exponent)
        return np.arange(1, many.sum() + 1) - np.repeat(np.cumsum(many) - many, many), np.repeat(np.arange(len(many)), many)

    back, of_end = distances(here)  # back from the block's end
    on, of_start = distances(here + then)  # on from its start
    low, q = np.r_[h[of_end + 1] - back, h[of_start]], np.r_[back, on]
    inside = low + q < names.n
    low, q = low[inside], q[inside]
    # all but one of the periods agree, so to one side at least half of these words do, and the greatest power of two within them
    level = np.log2(np.maximum(1, ((exponent - 1) * q + 1) // 2)).astype(np.int64)
    likely = np.zeros(len(q), bool)
    for k in range(min(int(level.max(initial=-1)) + 1, len(names.levels))):
        own = np.flatnonzero(level == k)
        name, a, b = names.levels[k], low[own], low[own] + q[own]
        before = a - (1 << k)
        likely[own] = (name[a] == name[b]) | ((before >= 0) & (name[np.maximum(before, 0)] == name[b - (1 << k)]))
    low, q = low[likely], q[likely]
    after, before = names.ahead(low, low + q), names.behind(low, low + q)
    length = q + after + before
    long_ = length >= np.maximum(shortest, exponent * q)
    start, end, q = (low - before)[long_], (low + q + after)[long_], q[long_]
    order = np.lexsort((q, end, start))
    start, end, q = start[order], end[order], q[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(q)]
    return list(zip(start[new].tolist(), q[new].tolist(), strict=True))


def _vocabulary(tree: Tree, seq: np.ndarray, covering: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """(node, period) of every square that a walk over suffix links meets."""
    marked: set[tuple[int, int]] = set()
    for start, q in covering:
        size = 2 * q
        node = tree.up(tree.rank[start], size)
        while (node, q) not in marked:
            marked.add((node, q))
            at = tree.order[tree.left[node]]
            if tree.depth[node] == size:  # the next word is a choice among children
                low, high, wanted = tree.left[node], tree.right[node], seq[at]
                while low < high:  # suffixes below a node are in the order of their next words
                    mid = (low + high) // 2
                    if seq[tree.order[mid] + size] < wanted:
                        low = mid + 1
                    else:
                        high = mid
                if seq[tree.order[low] + size] != wanted:
                    break
                node = tree.up(low, size + 1)
            elif seq[at + size] != seq[at]:
                break
            node = tree.up(tree.link(node), size)
    return marked


def runs(seq: np.ndarray, exponent: int = 4, shortest: int = 6) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of whole numbers whose last one is unique."""
    names = Names(seq)
    if names.n < shortest:
        return np.zeros((0, 3), np.int64)
    tree = Tree(names)
    marked = _vocabulary(tree, seq, _covering(names, tree.blocks(), exponent, shortest))
    if not marked:
        return np.zeros((0, 3), np.int64)
    found = [names.order[tree.left[v] : tree.right[v] + 1].astype(np.int64) + q * (names.n + 1) for v, q in marked]
    key = np.sort(np.concatenate(found))
    first = np.r_[True, key[1:] != key[:-1] + 1]
    at = np.flatnonzero(first)
    last = np.r_[at[1:], len(key)] - 1
    q, start = np.divmod(key[at], names.n + 1)
    length = key[last] - key[at] + 2 * q
    long_ = length >= np.maximum(shortest, exponent * q)
    return np.stack([start, length, q], axis=1)[long_]


def _repetitive(seq: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of all stretches, each of one owner, whose neighbouring triples occur three times or more in it."""
    if len(seq) < 6:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w, o = seq.astype(np.uint64), owner[:-2].astype(np.uint64)
    h = w[:-2] * _ODD[0] + w[1:-1] * _ODD[1] + w[2:] * _ODD[2] + o * _ODD[3]
    h = (h ^ h >> np.uint64(29)) * _ODD[1]
    bucket = (h >> np.uint64(64 - BITS)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    often = inside & (np.bincount(bucket[inside], minlength=1 << BITS)[bucket] >= 3)
    edge = np.flatnonzero(np.diff(np.r_[False, often, False].astype(np.int8)))
    # triples across two owners are never often, so a stretch has one owner
    start, end = edge[::2], edge[1::2] + 2
    long_ = end - start >= 6
    return start[long_], end[long_]


def chunk_runs(texts: list[np.ndarray], exponent: int = 4, shortest: int = 6) -> list[np.ndarray]:
    """The runs of each of several texts, each given as word numbers."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    seq, begin = np.concatenate(texts) if texts else np.zeros(0, np.int64), np.cumsum(sizes) - sizes
    starts, ends = _repetitive(seq, owner) if exponent >= 4 and shortest >= 6 else (begin, begin + sizes)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    separator = int(seq.max(initial=0)) + 1
    at = 0
    while at < len(starts):
        parts, origin, stop, n = [], [], at, 0
        while stop < len(starts) and (n == 0 or n + ends[stop] - starts[stop] <= TREE):
            a, b = int(starts[stop]), int(ends[stop])
            parts += [seq[a:b], [separator + stop - at]]
            origin += [np.arange(a, b), [-1]]
            n += b - a + 1
            stop += 1
        from_ = np.concatenate(origin)
        got = runs(np.concatenate(parts).astype(np.int64), exponent, shortest)
        got[:, 0] = from_[got[:, 0]]
        for t in np.unique(owner[got[:, 0]]).tolist():
            own = got[owner[got[:, 0]] == t]
            own[:, 0] -= begin[t]
            found[t].append(own)
        at = stop
    none = np.zeros((0, 3), np.int64)
    out = [np.concatenate(f) if f else none for f in found]
    return [x[np.lexsort((x[:, 2], x[:, 0]))] for x in out]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.cumsum(change)[:n] == 0


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def collapse(docs: DataFrame, id_col="doc_id", text_col="text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs (array of start, length, period in order), text with the first period of each run alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def settle(ids, plain, texts, numbers) -> pa.RecordBatch:
        found = chunk_runs(texts, exponent, shortest)
        words = list(numbers)
        out = [t if not len(f) else b" ".join([words[k] for k in s[kept_words(len(s), f)].tolist()]) for t, s, f in zip(plain, texts, found, strict=True)]
        cells = [[{"start": a, "length": b, "period": c} for a, b, c in f.tolist()] for f in found]
        return pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in texts], pa.int64()), pa.array(cells, shape), pa.array([t.decode() for t in out], pa.string())], ["id", "n_words", "runs", "text"])

    def run(batches):
        for b in batches:
            at, plain, texts, numbers, held = 0, [], [], _Numbers(), 0
            for k, cell in enumerate(b.column("text")):
                own, joined = [], []
                for part in stretches(cell.as_py() or ""):
                    words = part.encode("utf-8", "replace").split()
                    own.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                    joined += [b" ".join(words)] * bool(words)
                texts.append(np.concatenate(own) if own else np.zeros(0, np.int64))
                plain.append(b" ".join(joined))
                held += len(texts[-1])
                if held >= CHUNK:
                    yield settle(b.column("id").slice(at, k + 1 - at), plain, texts, numbers)
                    at, plain, texts, numbers, held = k + 1, [], [], _Numbers(), 0
            if texts:
                yield settle(b.column("id").slice(at), plain, texts, numbers)

    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, text string")


def with_periods(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` in which one text of ten is made periodic from a word on, by its id alone."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("_words").cast("long")
    rows = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", F.lit(1) + F.floor((n - F.col("_a")) / (3 + g % 8)))
    tail = F.transform(F.sequence(F.col("_a"), n - 1), lambda i: F.get("_words", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))
    made = F.concat_ws(" ", F.slice("_words", F.lit(1), F.col("_a").cast("int")), tail)
    return rows.withColumn(text_col, F.when(F.col("_a").isNotNull(), made).otherwise(F.col(text_col))).drop("_words", "_a", "_p")


def _highest(found: Column) -> Column:
    """The run of greatest length / period, compared as whole numbers; ties go to the smallest start, then period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")

    def better(best: Column, x: Column) -> Column:
        mine, other = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (mine > other), x).otherwise(best)  # runs come by start, then period

    return F.aggregate(found, none, better)


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = collapse(docs).withColumn("best", _highest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


# crc32 of the decimal id by its definition, then the runs by brute force: words q apart that are equal, in islands
SQL = r"""
WITH ids AS (
  SELECT doc_id, text, xor(4294967295, list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ord(substr(doc_id::VARCHAR, k::INTEGER, 1))::BIGINT),
    lambda c, b: list_reduce(range(0, 8), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(c, b)), 4294967295)) AS h
  FROM documents),
split AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM ids),
placed AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
periodic AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
words AS (
  SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word
  FROM (SELECT *, unnest(range(0, n)) AS i FROM periodic)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i
  FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (
  SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 1 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM equal)
  GROUP BY doc_id, q, g),
run AS (SELECT doc_id, start, length, min(q) AS period FROM island WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
best AS (
  SELECT doc_id, start, length, period FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM run) WHERE k = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
