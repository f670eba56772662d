"""SimHash near-duplicates through an inverted index of byte positions.

A fingerprint of 64 bits has 8 positional bytes. Two fingerprints that differ in
at most 4 bits share at least 4 of them, so tallying shared positional bytes
finds every such pair. The tally is not kept for every pair that shares one byte
(such lists hold a fixed share of all rows); instead the index has one list for
each value of certain three positions. The 20 triples are chosen so that any
four positions hold one of them, hence a pair that reaches the guaranteed count
of 4 meets in a list of 24 bits at least; there its shared bytes are counted,
pairs below the minimum go, and what is left is verified by its differing bits.
A pair is reported by the first triple that it shares.

Equal fingerprints are one entry. Lists of more than ``pairwise`` entries do not
report pairs but a spanning forest of the same components, found by search. Lists
of more than ``split`` entries are dealt out anew and never held: what three shared
positions guarantee of a fourth (a pair must share four) splits the list by each of
the five other positions; if a list of four shared bytes is still too long, the pair
shares at least four of the eight half bytes that are left, so it is split by each
four of these. A list then shares 48 bits and has 65,536 entries at most, whatever
the number of rows.

``near`` uses the same index for near-duplicates of a given similarity.

Defined cases: null and empty texts, and texts without a word, have fingerprint
0 and are linked like any other; texts with fewer words than a shingle are one
shingle; a null id takes part and is never the smallest of a component that has
another id; repeated rows are rows of the same component; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, stretches, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BITS = 4


def _triples() -> list[tuple[int, int, int]]:
    """Three of 8 positions, such that every 4 positions hold one of them: 20 triples.

    The positions fall into three classes; a triple lies in one class, or has
    two positions in a class and one in the next.
    """
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    out = [c for c in classes if len(c) == 3]
    for k, c in enumerate(classes):
        out += [(*two, one) for two in combinations(c, 2) for one in classes[(k + 1) % 3]]
    return out


TRIPLES = _triples()
MASKS = [sum(0xFF << 8 * p for p in t) for t in TRIPLES]


def _majority(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits in how many hashes it is set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return ones


def _written(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of a whole text."""
    ones, n, carry = np.zeros(64, np.int64), 0, []

    def add(shingles: list[bytes]) -> None:
        nonlocal ones, n
        ones += _majority(np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64))
        n += len(shingles)

    for part in stretches(text or ""):
        own = carry + part.encode("utf-8", "replace").translate(LOWER).split()
        if len(own) >= words:
            joined, ends = b" ".join(own), np.cumsum([len(w) + 1 for w in own]).tolist()
            add([joined[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])])  # noqa: B905
            carry = own[len(own) - words + 1 :]
        else:
            carry = own
    if not n:
        if not carry:
            return 0
        add([b" ".join(carry)])
    return _written(ones, n)


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, fp (the fingerprint as a signed long)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _forest(fp: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is linked within one list, by search over what is left."""
    out, left = [], fp
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                out.append((np.full(len(found), x), found))
                frontier.extend(found)
                left = left[~near]
    return out


def _children(masks: list[int]) -> list[tuple[int, int]]:
    """(mask, longer mask) for a list that is split: three bytes by a fourth, four bytes by four half bytes."""
    out = []
    for m in masks:
        free = [p for p in range(8) if not m >> 8 * p & 0xFF]
        if len(free) == 5:
            out += [(m, m | 0xFF << 8 * p) for p in free]
        else:
            halves = [0xF << 8 * p + h for p in free for h in (0, 4)]
            out += [(m, m | sum(four)) for four in combinations(halves, 4)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _links_of(m: np.ndarray, k: np.ndarray, fp: np.ndarray, bits: int, pairwise: int, split: int | None):
    """Links within the lists of a sorted stretch of the index, and the places of lists that are to be split."""
    start = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])])
    size = np.diff(np.r_[start, len(m)])
    long = size > split if split else np.zeros(len(size), bool)
    of = np.repeat(np.arange(len(start)), size)
    small = (size <= pairwise)[of] & ~long[of]
    masks = np.array(MASKS, np.uint64)
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for d in range(1, int(min(size.max(), pairwise))):
        a = np.flatnonzero((of[:-d] == of[d:]) & small[:-d])
        if not len(a):
            break
        x = fp[a] ^ fp[a + d]
        shared = sum((x >> np.uint64(8 * p) & np.uint64(0xFF)) == 0 for p in range(8))
        a, x = a[enough := shared >= 8 - bits], x[enough]
        a, x = a[near := np.bitwise_count(x) <= bits], x[near]
        first = masks[(x[:, None] & masks == 0).argmax(axis=1)]
        a = a[(first == m[a]) | ~np.isin(m[a], masks)]  # of several triples one reports a pair
        out.append((fp[a], fp[a + d]))
    for s in np.flatnonzero((size > pairwise) & ~long):
        out += _forest(fp[start[s] : start[s] + size[s]], bits)
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]), long[of]


def _searched(entries: DataFrame, bits: int, pairwise: int, split: int | None) -> DataFrame:
    """Lists (m, fp) of fingerprints that share the bits of mask m: links (a, b), and entries (a, m) of lists too long to hold."""

    def rows(a, b=None, m=None):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) if x is not None else pa.nulls(len(a), pa.int64()) for x in (a, b, m)], ["a", "b", "m"])

    def out(m, k, fp):
        a, b, long = _links_of(m, k, fp, bits, pairwise, split)
        yield rows(a, b)
        if long.any():
            yield rows(fp[long], None, m[long])

    def run(batches):
        held, passing = None, None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("m", "k", "fp")]
            if passing is not None:  # the list of the batch before goes on
                n = int(((now[0] == passing[0]) & (now[1] == passing[1])).sum())
                if n:
                    yield rows(now[2][:n].copy(), None, now[0][:n].copy())
                    now = [x[n:] for x in now]
                if not len(now[0]):
                    continue
                passing = None
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            m, k, fp = now
            last = int(np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (k[1:] != k[:-1])])[-1]) if len(m) else 0
            if last:
                yield from out(m[:last], k[:last], fp[:last])
            held = [x[last:].copy() for x in now]
            if split and len(held[0]) > split:
                yield rows(held[2], None, held[0])
                held, passing = None, (m[-1], k[-1])
        if held is not None and len(held[0]):
            yield from out(*held)

    keyed = entries.select("m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")
    return cut(keyed.repartition("m", "k").sortWithinPartitions("m", "k", "fp").mapInArrow(run, "a long, b long, m long"))


def links(nodes: DataFrame, bits: int = BITS, pairwise: int = 64, split: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that differ in at most ``bits`` bits."""
    if not 0 < bits <= BITS:
        raise ValueError(f"bits must be 1 to {BITS}: the index guarantees no more")
    found, masks = None, MASKS
    entries = nodes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("m"))
    for level in range(3):
        got = _searched(entries, bits, pairwise, split if level < 2 else None)
        some = got.filter("b is not null").select("a", "b")
        found = some if found is None else found.union(some)
        rest = got.filter("m is not null")
        if level == 2 or rest.isEmpty():
            break
        children = _children(masks)
        masks = sorted({c for _, c in children})
        table_ = nodes.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, c in children], "m long, child long")
        entries = rest.select(F.col("a").alias("fp"), "m").join(F.broadcast(table_), "m").select("fp", F.col("child").alias("m")).distinct()  # at most 4,900 rows are broadcast
    return found


def near_groups(prints: DataFrame, bits: int = BITS, pairwise: int = 64, split: int = 8192) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of ``prints`` (id, fp)."""
    nodes = prints.groupBy("fp").agg(F.min("id").alias("id"))
    found = cut(components(links(nodes.select("fp"), bits, pairwise, split)))
    least = found.join(nodes, found["node"] == nodes["fp"]).groupBy("component").agg(F.min("id").alias("least"))
    linked = found.join(least, "component").select(F.col("node").alias("fp"), "least")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "id").alias("component_id"))


def near_groups_of(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """``prints`` (id, fp, run) with component_id.

    run: the partition a row came from. A fingerprint that a third of all rows
    share goes back to them by (fp, run), so no task gets all of them.
    """
    groups = near_groups(prints, bits)
    dealt = prints.select("fp", "run").distinct().join(groups.select("fp", "component_id"), "fp")
    return prints.join(dealt, ["fp", "run"])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    prints = cut(fingerprints(table(spark, sf_dir, "documents")).withColumn("run", F.spark_partition_id()))
    return near_groups_of(prints).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
