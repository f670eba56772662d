"""Near-duplicates of a given similarity of word shingles: SimHash proposes, an exact index completes.

The similarity of two texts is that of their sets of shingles of ``words`` words
(intersection by union). Linked are all texts of ``least`` or more; of each
group of linked texts one stays.

1. Texts of equal sets are linked; one stands for each set from here on.
2. SimHash: a 64-bit fingerprint of each set goes through the byte-position index
   of ``simhash.links``; what lies within 4 bits is verified on the whole sets.
3. 4 bits can't guarantee a similarity of 0.8, so an inverted index finds every
   pair that is left. Sets have one global order of shingles, rarest first. Of n
   shingles a similar set holds ``least`` * n at least, so of any two similar sets
   each holds, among its first n - least * n + 1, one that both have. A shingle
   that one set alone has (most are) leads to nobody, so a set is in the index
   only if less than a fifth of it is its own, and there only with what its first
   fifth holds of shared shingles.

How often a shingle occurs is counted over all sets: hashes go out in packed
blocks, one for each range of hashes and stretch of documents; a range returns
the shared ones. Shingles of so large a share of all documents that one range
could not hold their list are found before, are bounded in number (``HOT_MOST``)
and come last in the order, in which no range has to count them.

In a list of the index, only pairs count whose place in both sets leaves room for
the overlap that their sizes ask for; sets for which no partner of the list's sizes
leaves room go first. Then, ``rounds`` times, all members of a list are tested
against one (that of most links which has not yet led), and
lists whose members are in one component are done: a hub and its copies never become a square.

What is left in large lists is told apart by differences. Two sets differ by just
what their differences to any third set differ by. The reference of all that
large lists connect is what most of a few of these hold; many copies of one text differ from it by little, and two of
them are similar only if their differences are (nearly) the same to a known part. So the
same index is made once more, within each list, of differences instead of sets:
finer lists, in which again only those meet whose place leaves room, and which are
told apart again if many still fit. Sets whose differences alone are small enough
are similar to that of the least, which links them. Small lists meet as they are.
Pairs whose tallies rule the similarity out are left away; all others are
verified on both whole sets. None of ``HOT_SHARE``, ``rounds``, the blocks, the
references or the fingerprints changes the result.

Defined cases: a null text is an empty one; texts without a word are equal; texts
with fewer words than a shingle are one shingle; of a group the smallest id stays,
a null id after all others, then the smaller text hash; rows of equal id and text
are one document and stay or go together; rows of equal id and other text are
documents of their own; an empty table gives an empty result; other columns pass
through. Exactness is up to 64-bit hashes of shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import compact, components, cut, forgetful, release, small_batches, stretches, tidied, tidy, unsent
from .simhash import BITS, LOWER, links

#: Distinct words whose hashes a worker remembers.
REMEMBER = 200_000
#: Shingles that a worker gathers before it hands on blocks, and shingles that a range of hashes should hold.
CHUNK, RANGE = 1 << 19, 1 << 21
#: A shingle of this share of all documents is hot; so many are known to every worker at most.
HOT_SHARE, HOT_MOST = 400, 1_000_000
#: A list is dealt out by what tells its members from a reference if it has more than ``SMALL`` members and one for each
#: ``WORTH`` shingles that a member holds there, so many times over; about ``SAMPLE`` members choose a reference.
#: Pairs of finer lists that average no more than ``LOOK`` members are counted before more is done.
SMALL, WORTH, SAMPLE, LEVELS, LOOK = 16, 8, 24, 2, 1000
EPS = 1e-6
SUMMARY = "tag long, h long, n long, sum binary, tally binary, fp long, hot array<long>, z binary"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 3)
        return got


_WORDS = _Words()


def forget() -> None:
    _WORDS.clear()


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` neighbours."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    out = (out ^ out >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(31)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted (one of all words if there are fewer)."""
    found, carry, any_ = [], np.zeros(0, np.uint64), False
    for part in stretches(text or ""):
        own = part.encode("utf-8", "replace").translate(LOWER).split()
        chain = np.concatenate([carry, np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))])
        carry = chain[max(0, len(chain) - words + 1) :]
        if len(chain) >= words:
            any_ = True
            found.append(_rolled(chain, words))
    if not any_ and len(carry):
        found.append(_rolled(carry, len(carry)))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets; two empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def _simhash(shingles: np.ndarray) -> int:
    """Bits that more than half of the hashes have, as a signed long."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), 1 << 16):
        ones += np.unpackbits(shingles[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def _tally(shingles: np.ndarray) -> bytes:
    """How many shingles fall to each of 64 values; two tallies differ by no more than their sets do."""
    return np.minimum(np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def _chunks(batches, words: int, columns: list[str]):
    """Shingle sets of a stream in chunks of about ``CHUNK``: (cells of ``columns``, texts, sets)."""
    cells, texts, sets, n = [[] for _ in columns], [], [], 0
    for b in batches:
        held = [b.column(c).to_pylist() for c in columns]
        for k, text in enumerate(b.column("text")):
            texts.append(text.as_py())
            sets.append(shingle_set(texts[-1], words))
            for into, values in zip(cells, held, strict=True):
                into.append(values[k])
            n += len(sets[-1]) + 16
            if n >= CHUNK:
                yield cells, texts, sets
                cells, texts, sets, n = [[] for _ in columns], [], [], 0
    if sets:
        yield cells, texts, sets


def _hot(rows: DataFrame, words: int, docs: int) -> np.ndarray:
    """Shingles of about one in ``HOT_SHARE`` documents or more, sorted.

    Each chunk reports what half that share of its own documents has; a shingle of
    the full share reaches half of it in the sum of the reports.
    """

    def run(batches):
        for _, _, sets in _chunks(batches, words, []):
            found, n = np.unique(np.concatenate(sets), return_counts=True)
            many = n >= max(2, len(sets) // (2 * HOT_SHARE))
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many])], ["s", "n"])

    heavy = rows.select("text").mapInArrow(forgetful(forget, run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(32, docs // (2 * HOT_SHARE)))
    got = heavy.orderBy(F.desc("n"), "s").limit(HOT_MOST).select("s").toArrow().column("s")
    return np.sort(got.to_numpy().view(np.uint64))


def _place(shingles: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of each hash, and its name there."""
    return (shingles >> np.uint64(32)) % np.uint64(ranges), shingles & np.uint64(0xFFFFFFFF)


def _summaries(rows: DataFrame, words: int, hot: np.ndarray, ranges: int) -> DataFrame:
    """Computed once: a summary of each row (``range`` -1) and the blocks of hashes for the ranges."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(hot)
    schema = f"range int, id {kind}, {SUMMARY}"

    def run(batches):
        hot, squeeze = shared.value, zstandard.ZstdCompressor(1).compress
        id_type, base = None, TaskContext.get().partitionId() << 33

        def keep(batches):
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("id").type
                yield b

        for (ids, h), texts, sets in _chunks(keep(batches), words, ["id", "h"]):
            tags = base + np.arange(len(sets))
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(x) for x in sets])
            at = np.minimum(np.searchsorted(hot, every), max(0, len(hot) - 1))
            is_hot = hot[at] == every if len(hot) else np.zeros(len(every), bool)
            of, name = _place(every, ranges)
            names = (of.astype(np.int64) << 32 | name.astype(np.int64))[is_hot]
            bounds = np.searchsorted(owner[is_hot], np.arange(len(sets) + 1))
            hots = [np.sort(names[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sets), -1, np.int32)), pa.array(ids, id_type), pa.array(tags), pa.array(h, pa.int64()), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([_tally(x) for x in sets], pa.binary()),
                    pa.array([_simhash(x) for x in sets], pa.int64()), pa.array(hots, pa.list_(pa.int64())), pa.array([squeeze((t or "").encode("utf-8", "replace")) for t in texts], pa.binary()),
                ],
                names=names_of,
            )
            of, name, owner = of[~is_hot], name[~is_hot].astype(np.uint32), owner[~is_hot]
            order = np.argsort(of.astype(np.uint32), kind="stable")
            of, name, owner = of[order], name[order], owner[order]
            if not len(of):  # no text with a word, or nothing but hot shingles
                base += len(sets)
                continue
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            blocks = [(int(of[a]), name[a:b].tobytes(), squeeze(np.diff(owner[a:b], prepend=np.uint32(0)).tobytes())) for a, b in zip(start, np.r_[start[1:], len(of)].astype(int), strict=True)]
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in blocks], pa.int32()), pa.nulls(len(blocks), id_type), pa.array(np.full(len(blocks), base)), none, none, pa.array([x[1] for x in blocks], pa.binary()),
                    pa.nulls(len(blocks), pa.binary()), none, pa.nulls(len(blocks), pa.list_(pa.int64())), pa.array([x[2] for x in blocks], pa.binary()),
                ],
                names=names_of,
            )
            base += len(sets)

    names_of = [c.strip().split(" ")[0] for c in schema.split(", ")]
    return cut(rows.mapInArrow(forgetful(forget, run), schema))


def _settle(block: pa.Table) -> pa.Table:
    """Of one range of hashes those that more than one row has: (tag, s, df), a row for each of their rows."""
    tidy()
    unzip = zstandard.ZstdDecompressor().decompress
    names = [np.frombuffer(x, np.uint32) for x in block.column("sum").to_pylist()]
    tags = [base + np.cumsum(np.frombuffer(unzip(z), np.uint32), dtype=np.int64) for base, z in zip(block.column("tag").to_pylist(), block.column("z").to_pylist(), strict=True)]
    name, tag = np.concatenate(names), np.concatenate(tags)
    del names, tags
    order = np.argsort(name, kind="stable")
    name, tag = name[order], tag[order]
    start = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
    size = np.diff(np.r_[start, len(name)])
    mine = np.repeat(size > 1, size)
    again = np.r_[False, (name[1:] == name[:-1]) & (tag[1:] == tag[:-1])]  # two shingles of one text by one name
    s = (again[mine].astype(np.int64) << 61) | (np.int64(block.column("range")[0].as_py()) << 32) | name[mine].astype(np.int64)
    return pa.table({"tag": tag[mine], "s": s, "df": np.repeat(size, size)[mine].astype(np.int32)})


def _kept(df: DataFrame) -> DataFrame:
    """The rows of ``df`` in the checkpoint folder; what was shuffled on the way there is let go."""
    spark = df.sparkSession
    out = compact(df)
    del df
    release(spark)
    return out


class _Verifier:
    """Tests pairs of rows on their whole sets, each pair once."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, least: float):
        self.sizes, self.sets, self.least, self.tried = nodes.select("tag", "n", "tally"), sets, least, None

    def _both(self, pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("tag").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of ``pairs`` that are similar and were not tested before."""
        least, limit = self.least, (1 - self.least) / (1 + self.least)
        pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
        pairs = _kept(pairs if self.tried is None else pairs.join(self.tried, ["a", "b"], "left_anti"))
        self.tried = pairs if self.tried is None else _kept(self.tried.union(pairs))

        def near(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 64).astype(np.int64) for c in ("tally_a", "tally_b"))
                # counts over 255 are cut, which only makes the difference smaller
                keep = np.abs(x - y).sum(axis=1) <= limit * (b.column("n_a").to_numpy() + b.column("n_b").to_numpy()) + 1e-6
                yield b.select(["a", "b"]).filter(pa.array(keep))

        def verify(batches):
            for b in batches:
                sides = [b.column(c) for c in ("set_a", "set_b")]
                keep = [similarity(*(np.frombuffer(c[k].as_buffer(), np.uint64) for c in sides)) >= least - 1e-9 for k in range(len(b))]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        likely = _kept(self._both(pairs, self.sizes, ["n", "tally"]).select("a", "b", "n_a", "n_b", "tally_a", "tally_b").mapInArrow(tidied(near), "a long, b long"))
        return _kept(self._both(likely, self.sets, ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(tidied(verify), "a long, b long"))


    def differences(self, rows: DataFrame, bases: DataFrame) -> DataFrame:
        """``rows`` (s, tag, n, rm, of, own) with own as what one of own and the reference of the list s has and the other not (``bases``: s, base), in one order for each list."""

        def apart(batches):
            for b in batches:
                found = []
                for own, base in zip(b.column("own"), b.column("base"), strict=True):
                    own, base = (np.asarray(v.values) if v.is_valid else np.zeros(0, np.int64) for v in (own, base))
                    found.append(np.concatenate([own[~np.isin(own, base)], base[~np.isin(base, own)]]))
                ends = np.cumsum([0, *map(len, found)])
                yield b.select(["s", "tag", "n", "rm", "of"]).append_column("own", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64())))

        return _kept(rows.join(bases, "s", "left").select("s", "tag", "n", "rm", "of", "own", "base").mapInArrow(tidied(apart), "s long, tag long, n long, rm double, of long, own array<long>"))


def _bases(rows: DataFrame) -> DataFrame:
    """(s, base): what most of about ``SAMPLE`` members of a list have in own, what most of these lack least last. Any reference is right, a good one is fast."""

    def most(batches):
        for b in batches:
            found = []
            for owns in b.column("owns"):
                own, n = np.unique(np.asarray(owns.values.flatten()), return_counts=True)
                order = np.lexsort((own, -n))
                found.append(own[order][n[order] * 2 > len(owns)])
            ends = np.cumsum([0, *map(len, found)])
            yield b.select(["s"]).append_column("base", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int64())))

    some = rows.filter(F.pmod(F.xxhash64("tag", "s"), F.col("size")) < SAMPLE)
    return some.groupBy("s").agg(F.collect_list("own").alias("owns")).mapInArrow(tidied(most), "s long, base array<long>")


def _step(value: Column) -> Column:
    return F.floor(4 * F.log2(F.greatest(value, F.lit(1.0))))


def _fits(least: float) -> Column:
    """Whether two entries of a list, the second's columns with a 2, leave room for the overlap that their sizes ask for."""
    sizes = F.col("n") * least - 1e-6 <= F.col("n2")
    need = F.col("e") + F.col("e2") - 2 * EPS
    return (F.col("of") != F.col("of2")) & sizes & (F.col("n2") * least - 1e-6 <= F.col("n")) & (need > 0) & (need <= 2 * F.least("rem", "rem2"))


def _all_pairs(lists: DataFrame, least: float) -> DataFrame:
    rows = lists.select("s", "tag", "n", "e", "rem", "of")
    other = rows.select("s", *[F.col(c).alias(f"{c}2") for c in rows.columns[1:]])
    return rows.join(other, "s").filter((F.col("tag") > F.col("tag2")) & _fits(least)).select(F.col("tag").alias("a"), F.col("tag2").alias("b")).distinct()


def _finer(lists: DataFrame, own: DataFrame, verified: _Verifier, least: float, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, lists, own): pairs of small lists and of what is similar for certain, and finer lists of the large ones with what their members hold there.

    whole: the lists are of whole sets; all that such lists connect then has one reference.
    """
    held = F.col("e") + F.col("rm")
    sizes = lists.groupBy("s").agg(F.count("*").alias("size"), F.avg(held).alias("held"))
    marked = _kept(lists.join(sizes, "s").withColumn("large", F.col("size") > F.greatest(F.lit(SMALL), F.col("held") / WORTH)))
    rows = marked.filter("large")
    if whole:  # a text is in many lists of whole sets: once is enough
        firsts = rows.groupBy("s").agg(F.min("tag").alias("b"))
        group = _kept(components(rows.join(firsts, "s").select(F.col("tag").alias("a"), "b")))
        rows = rows.drop("s", "size").dropDuplicates(["tag"]).join(group.select(F.col("node").alias("tag"), F.col("component").alias("s")), "tag")
        rows = rows.join(group.groupBy(F.col("component").alias("s")).agg(F.count("*").alias("size")), "s")
    rows = _kept(rows.join(own, ["parent", "tag"]).select("s", "tag", "n", "rm", "of", "size", "own"))
    apart = verified.differences(rows, _bases(rows)).withColumn("e", F.size("own") - F.col("rm"))
    steps = apart.groupBy("s", _step(F.size("own") + F.col("rm") + 2 * EPS).alias("at")).agg(F.min("e").alias("e"), F.min(F.struct("e", "tag", "of")).alias("low"))
    stairs = steps.groupBy("s").agg(F.collect_list(F.struct("at", "e")).alias("stairs"), F.min("low").alias("low"))
    apart = _kept(apart.join(stairs, "s"))
    certain = apart.filter((F.col("of") != F.col("low.of")) & (F.col("e") + F.col("low.e") <= 2 * EPS)).select(F.col("tag").alias("a"), F.col("low.tag").alias("b"))
    # of those that can have enough of what a text has, the one that asks for least
    partner = F.array_min(F.transform(F.filter("stairs", lambda x: x["at"] >= _step(F.col("e"))), lambda x: x["e"]))
    first = (F.size("own") - F.greatest(F.ceil((F.col("e") + partner) / 2 - EPS), F.lit(1)) + 1).cast("int")
    told = apart.withColumn("first", first).filter("first > 0").select("s", "tag", "n", "rm", "e", F.size("own").alias("size"), F.posexplode(F.slice("own", F.lit(1), F.col("first"))).alias("k", "x"))
    finer = told.select(F.xxhash64("s", "x").alias("s"), F.col("s").alias("parent"), "tag", "n", "rm", "e", (F.col("size") - F.col("k")).alias("rem"))
    return _all_pairs(marked.filter("not large"), least).union(certain), finer, apart.select(F.col("s").alias("parent"), "tag", "own")


def _index(held: DataFrame, nodes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(lists, own): lists (s, parent, tag, n, rm, e, rem) of the shared shingles in the first part of each set; own (parent, tag, own) has all shared ones, rarest first."""
    settled = held.filter("range >= 0").select("range", "tag", "sum", "z").groupBy("range").applyInArrow(_settle, "tag long, s long, df int")
    shared = settled.groupBy("tag").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    sets = nodes.select("tag", "n", "hot").join(shared, "tag", "left").withColumn("shared", F.coalesce("shared", F.array()))
    alone = F.col("n") - F.size("shared") - F.size("hot")
    first = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-6) + 1
    sets = sets.withColumns({"alone": alone, "more": (first - alone).cast("int")}).filter("more > 0")
    own = F.concat(F.transform("shared", lambda x: x["s"]), F.transform("hot", lambda x: -1 - x))
    sets = _kept(sets.select(F.lit(0).cast("long").alias("parent"), "tag", "n", "more", own.alias("own")))
    m, e = F.size("own"), F.lit(2 * least / (1 + least)) * F.col("n")
    lists = sets.select(F.posexplode(F.slice("own", F.lit(1), F.col("more"))).alias("k", "s"), "parent", "tag", "n", (m - e).alias("rm"), e.alias("e"), m.alias("m"))
    return _kept(lists.select("s", "parent", "tag", "n", "rm", "e", (F.col("m") - F.col("k")).alias("rem"))), sets.select("parent", "tag", "own")


def linked(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, least: float = 0.8, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has tag, id and h (hash of the text) of each row; groups (node, component) of all tags that are linked."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    count, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    held = _summaries(rows, words, _hot(rows, words, count), max(64, chars // 4 // RANGE))
    every = held.filter("range = -1")

    # equal sets, by way of the partition that a row is from, so that no task gets all rows of a hot one
    run = F.shiftright("tag", 33).alias("run")
    in_run = every.groupBy("sum", run).agg(F.min("tag").alias("tag"))
    dealt = in_run.select("sum", "run").join(in_run.groupBy("sum").agg(F.min("tag").alias("first")), "sum")
    of_sets = every.select("tag", "sum", run).join(dealt, ["sum", "run"]).select("tag", "first")
    equal = _kept(of_sets.filter("tag != first").select(F.col("tag").alias("a"), F.col("first").alias("b")))
    nodes = cut(every.join(equal.select(F.col("a").alias("tag")), "tag", "left_anti").select("tag", "n", "tally", "fp", "hot"))
    slim = cut(every.select("tag", "id", "h"))
    del in_run, dealt, of_sets
    release(spark)
    lists, own = _index(held, nodes, least)

    # SimHash: one neighbour for each fingerprint and each row
    firsts = cut(nodes.groupBy("fp").agg(F.min("tag").alias("first")))
    same = nodes.join(firsts, "fp").filter("tag != first").select(F.col("tag").alias("a"), F.col("first").alias("b"))
    ends = links(firsts.select("fp"), BITS).withColumnRenamed("a", "x").withColumnRenamed("b", "y")
    far = ends.join(firsts.select(F.col("fp").alias("x"), F.col("first").alias("a")), "x").join(firsts.select(F.col("fp").alias("y"), F.col("first").alias("b")), "y").select("a", "b")
    proposed = _kept(same.union(far).distinct())
    del firsts, same, ends, far
    release(spark)

    def sets_of(batches):
        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                found = [shingle_set(unzip(z).decode("utf-8", "replace"), words).tobytes() for z in part.column("z").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("tag"), pa.array(found, pa.binary())], ["tag", "set"])

    wanted = lists.select("tag").union(proposed.select("a")).union(proposed.select("b")).distinct()
    sets = cut(every.select("tag", "z").join(wanted, "tag", "left_semi").mapInArrow(forgetful(forget, sets_of), "tag long, set binary"))
    del every, held, wanted
    release(spark)
    verified = _Verifier(nodes, sets, least)
    found = _kept(equal.union(verified(proposed)))
    group, led, level, r = _kept(components(found)), None, 0, 0
    while True:
        ends = found.select(F.col("a").alias("tag")).union(found.select(F.col("b").alias("tag"))).groupBy("tag").agg(F.count("*").alias("degree"))
        known = group.withColumnRenamed("node", "tag").join(ends, "tag", "left")
        known = known if led is None else known.join(led, "tag", "full")
        known = known if led is not None else known.withColumn("led", F.lit(False))
        of = lists.join(known, "tag", "left").withColumn("of", F.coalesce("component", "tag"))
        bounds = of.groupBy("s").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.min("e").alias("e2")).filter("low != high").select("s", "e2")
        other = F.col("e2") if level else F.greatest("e2", 2 * least / (1 + least) * F.ceil(F.lit(least) * F.col("n") - 1e-6))
        open_ = of.join(bounds, "s").filter(F.col("e") + other - 2 * EPS <= 2 * F.col("rem"))
        lists = _kept(open_.select("s", "parent", "tag", "n", "rm", "e", "rem", "of", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("led", F.lit(False)).alias("led")))
        sizes = lists.groupBy("s").agg(F.count("*").alias("size"))
        square, total = sizes.agg(F.sum(F.col("size").cast("double") * F.col("size")), F.sum("size")).first()
        del ends, known, of, bounds, open_, sizes
        if not total:
            break
        few = square <= 8 * total or level and square <= LOOK * total and _all_pairs(lists, least).count() <= 2 * total
        last = few or level == LEVELS and r == 1
        columns = ["s", "parent", "tag", "n", "rm", "e", "rem"]
        if last:
            new = verified(_all_pairs(lists, least))
        elif r == (1 if level else rounds):
            pairs, lists, own = _finer(lists, own, verified, least, level == 0)
            new, level, r = verified(pairs), level + 1, 0
        else:
            key = F.struct("led", (-F.col("degree")).alias("degree"), F.xxhash64("tag", F.lit(r)).alias("x"), "tag", "n", "e", "rem", "of")
            other = lists.groupBy("s").agg(F.min(key).alias("lead")).select("s", "lead.tag", "lead.n", "lead.e", "lead.rem", "lead.of")
            now = other.select("tag", F.lit(True).alias("led")).distinct()
            led = _kept(now if led is None else led.union(now).distinct())
            other = other.select("s", *[F.col(c).alias(f"{c}2") for c in ("tag", "n", "e", "rem", "of")])
            pairs = lists.join(other, "s").filter(_fits(least))
            new, r = verified(pairs.select(F.col("tag").alias("a"), F.col("tag2").alias("b")).distinct()), r + 1
        if not new.isEmpty():  # on from the groups so far, which are stars
            found = _kept(found.union(new))
            group = _kept(components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(new)))
        lists = lists.select(*columns)
        if last:
            break
    return slim, group


def similar_groups(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, least: float = 0.8) -> DataFrame:
    """(tag, id, h, keep) for each row in a group of two or more: keep has the id and h of the row that stays."""
    with small_batches(docs.sparkSession), unsent(docs.sparkSession):
        rows, group = linked(docs, id_col, text_col, words, least)
    members = group.join(rows.withColumnRenamed("tag", "node"), "node")
    best = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("keep"))
    return members.join(best, "component").select(F.col("node").alias("tag"), "id", "h", "keep")


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of similar ones, all columns kept."""
    groups = similar_groups(docs, id_col, text_col, words, least)
    same = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("h") == F.col("keep.h"))
    gone = cut(groups.filter(~same).select(F.col("id").alias("_gone"), F.col("h").alias("_gone_h")).distinct())
    del groups
    release(docs.sparkSession)
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (h == F.col("_gone_h")), "left_anti")
