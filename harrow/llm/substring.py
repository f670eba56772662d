"""Removal of repeated word windows, found by recompression.

Every document's word sequence is recompressed: runs of one word become a
symbol, then, in rounds, a left symbol followed by a right one (the side is a bit
of the symbol's name) becomes a pair symbol. Names are computed from what they
stand for, so every task gives equal substrings the same names without a shared
dictionary, and the pairing of a place depends on a few neighbours only. For
every symbol the words on which its being there depends are known; whoever has
the same words there has the same symbol. Each window of ``window`` words takes
the highest symbol that depends on words of the window alone (of several, the one
of least name), so equal windows always take the same symbol at the same place.

Round one of the exchange finds the symbols that more than one document has.
Round two compares only the windows whose symbol is shared, by 96-bit hashes of
their words, which settles which of them also start in a document of smaller id.
Before each exchange a task keeps one entry for each name, that of its smallest
id: for all others of the task the answer is known already. So a passage that a
third of all documents share sends one entry from each task, and an entry is 8
to 15 bytes in a packed block. What a bucket has settled goes on in blocks as well, one for
each range of documents, so the number of blocks is that of buckets and ranges, not of documents. Texts are compressed before a join moves them; the joins
sort, so they spill where a partition is larger than memory. Over all documents
windows are told apart by 96 bits; which windows of one document these are, by 64.

Defined cases: a null text has no words; a null id counts as larger than all
others and no null id as smaller than another (such rows travel under one of
``NULLS`` numbers, by their text, so they never meet in one task); rows with equal ids
count as one document for the rule (neither is smaller), each gets its own result;
windows never cross documents; a very long
text is handled in overlapping segments with the same result; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forgetful, packed, release, stretches, table, unpacked

ROUNDS = 4
#: Words of one segment, and about how many are handled at once.
SEGMENT, GROUP = 1 << 18, 1 << 19
REMEMBER = 200_000
#: Numbers that stand for a null id: NO_ID and those below it.
NULLS, NO_ID = 4096, (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_WORDS = _Words()


def forget() -> None:
    _WORDS.clear()


def _rank(ids: np.ndarray) -> np.ndarray:
    """Ids as the rule compares them: all null ids alike."""
    return np.minimum(ids, NO_ID - NULLS)


def words_of(text: str | None):
    """The words of a text, in lists of bounded size."""
    for part in stretches(text or ""):
        yield part.encode("utf-8", "replace").split()


def hashes_of(text: str | None) -> np.ndarray:
    found = [np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w)) for w in words_of(text)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(29)) * _MIX
    return (x ^ x >> np.uint64(32)) * _FOLD


def levels(words: np.ndarray, wall: np.ndarray, rounds: int = ROUNDS):
    """(name, lo, hi) of every symbol, level by level, the words first.

    lo, hi: a symbol is there because of the words lo to hi (not included). A
    wall stands between documents and is never part of anything else.
    """
    at = np.arange(len(words))
    yield words, at, at + 1
    # runs of one word
    head = np.r_[True, (words[1:] != words[:-1]) | wall[1:] | wall[:-1]]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(words)]
    name = np.where(last - first > 1, _mixed(words[first] + (last - first).astype(np.uint64) * _FOLD), words[first])
    lo, hi, wall = first - 1, np.minimum(last + 1, len(words)), wall[first]  # -1: before the sequence, so in no window
    yield name, lo, hi
    for k in range(rounds):
        right = _mixed(name + np.uint64(k + 1)) >> np.uint64(63) == 1
        joins = ~right[:-1] & right[1:] & ~wall[:-1] & ~wall[1:]
        head = np.r_[True, ~joins]
        first = np.flatnonzero(head)
        joined = np.r_[joins, False][first]
        # a pair is one whatever stands around it; a lone left symbol depends on what follows, a lone right one on what precedes
        lone_right = ~joined & right[first]
        lo = np.where(lone_right, lo[np.maximum(first - 1, 0)], lo[first])
        hi = np.where(lone_right, hi[first], hi[np.minimum(first + 1, len(name) - 1)])
        name = np.where(joined, _mixed(name[first] * _FOLD + name[np.minimum(first + 1, len(name) - 1)]), name[first])
        wall = wall[first]
        yield name, lo, hi


def _spans_hash(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, factor: int) -> np.ndarray:
    """A hash of the words lo to hi for each pair, the same wherever they stand."""
    n = len(words) + 1
    base, back = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base)])
    down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, back)])
    total = np.r_[np.uint64(0), np.add.accumulate(words * up[: len(words)])]
    return _mixed((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def window_names(words: np.ndarray, wall: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows without a wall, and the name of the symbol each takes."""
    walls = np.r_[0, np.cumsum(wall)]
    starts = np.flatnonzero(walls[window:] == walls[:-window]) if len(words) >= window else np.zeros(0, np.int64)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    open_ = np.zeros(len(words) - window + 1, bool)
    open_[starts] = True
    chosen = np.zeros(len(open_), np.uint64)
    for name, lo, hi in reversed(list(levels(words, wall))):
        least = np.full(len(open_), np.uint64((1 << 64) - 1))
        fits = np.flatnonzero((hi - lo <= window) & (lo < len(open_) + window))
        name_, lo_, hi_ = _spans_hash(words, lo[fits], hi[fits], 0x9FB21C651E98DF25), lo[fits], hi[fits]
        todo = np.r_[0, np.cumsum(open_)]
        a, b = np.maximum(hi_ - window, 0), np.minimum(lo_, len(open_) - 1)
        some = (a <= b) & (todo[np.maximum(b, a) + 1] > todo[np.minimum(a, len(open_))])
        name_, a, b = name_[some], a[some], b[some]
        for k in range(window):
            here = np.flatnonzero(a + k <= b)
            if not len(here):
                break
            np.minimum.at(least, a[here] + k, name_[here])
        got = open_ & (least != np.uint64((1 << 64) - 1))
        chosen[got] = least[got]
        open_ &= ~got
        if not open_.any():
            break
    return starts, chosen[starts]


def _grouped(items):
    """Lists of (key, word hashes) with about GROUP words together; long texts in overlapping segments."""
    held, n = [], 0
    for key, words, window in items:
        for at in range(0, max(1, len(words) - window + 1), SEGMENT):
            held.append((key, words[at : at + SEGMENT + window - 1]))
            n += len(held[-1][1])
            if n >= GROUP:
                yield held
                held, n = [], 0
    if held:
        yield held


def _laid_out(held):
    """One word sequence of several segments with walls between, and the index of the segment at each place."""
    sizes = np.array([len(w) for _, w in held])
    total = int(sizes.sum()) + len(held)
    words, wall, of = np.zeros(total, np.uint64), np.zeros(total, bool), np.zeros(total, np.int64)
    at = 0
    for k, (_, w) in enumerate(held):
        words[at : at + len(w)] = w
        wall[at + len(w)] = True
        of[at : at + len(w) + 1] = k
        at += len(w) + 1
    return words, wall, of


def _planes(columns: list[tuple[np.ndarray, int]]) -> bytes:
    """Numbers as planes of their low bytes, compressed: planes of small numbers all but vanish."""
    return zstandard.compress(b"".join(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in columns), 1)


def _unplaned(data: bytes, widths: list[int]) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, at, out = len(raw) // sum(widths), 0, []
    for width in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(x.view(np.uint64).ravel())
        at += n * width
    return out


def _low(x: np.ndarray, width: int) -> np.ndarray:
    return x if width == 8 else x & np.uint64((1 << 8 * width) - 1)


def _sent(keys: list[np.ndarray], ids: np.ndarray, buckets: int, ranges: int, all_shared: bool, widths: list[int]):
    """Blocks to exchange for entries (keys, id): what this task knows already, and one entry for each key.

    all_shared: every document of a key that several have is told; else only those that are not the smallest.
    widths: how many low bytes of each key are kept. Yields (bucket, range, ids, data); range -1: not settled yet.
    """
    bucket = (keys[0] >> np.uint64(11)) % np.uint64(buckets)
    keys = [_low(k, w) for k, w in zip(keys, widths, strict=True)]
    order = np.lexsort((ids, *reversed(keys)))
    keys, ids, bucket = [k[order] for k in keys], ids[order], bucket[order]
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])] if len(ids) else np.zeros(0, bool)
    one = new | np.r_[True, ids[1:] != ids[:-1]] if len(ids) else new  # one entry for each key and id
    keys, ids, new, bucket = [k[one] for k in keys], ids[one], new[one], bucket[one]
    if not len(ids):
        return
    size = np.diff(np.r_[np.flatnonzero(new), len(ids)])
    told = np.repeat(size > 1, size) & (True if all_shared else _rank(ids) > np.repeat(_rank(ids[new]), size))
    for of, owners, blob in _by_range(keys[0][told], ids[told], ranges, widths[0]):
        yield of % buckets, of, owners, blob
    keys, ids, bucket = [k[new] for k in keys], ids[new], bucket[new]
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]])
    for a, b in zip(edges, np.r_[edges[1:], len(order)], strict=True):
        own = order[a:b]
        yield int(bucket[own[0]]), -1, None, _planes([*((k[own], w) for k, w in zip(keys, widths, strict=True)), (ids[own], 8)])


def _by_range(keys: np.ndarray, ids: np.ndarray, ranges: int, width: int):
    """(range, ids, data): one block for each range of documents, whose ids and numbers of keys are in ``ids``."""
    if not len(ids):
        return
    of = (_mixed(ids.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((keys, ids, of))
    keys, ids, of = keys[order], ids[order], of[order]
    edges = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = ids[a:b]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        yield int(of[a]), _planes([(own[first], 8), (np.diff(np.r_[first, b - a]), 8)]), _planes([(keys[a:b], width)])


def _gathered(block: pa.Table, width: int) -> pa.Table:
    """(id, told) of one range of documents: the keys of each, sorted."""
    owners, keys = [], []
    for who, data in zip(block.column("ids").to_pylist(), block.column("data").to_pylist(), strict=True):
        ids, n = _unplaned(who, [8, 8])
        owners.append(np.repeat(ids.view(np.int64), n.astype(np.int64)))
        keys.append(_unplaned(data, [width])[0])
    ids, keys = np.concatenate(owners), np.concatenate(keys)
    del owners
    order = np.lexsort((keys, ids))
    ids, keys = ids[order], keys[order]
    edges = np.r_[np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), len(ids)]
    told = [_planes([(keys[a:b], width)]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"id": pa.array(ids[edges[:-1]], pa.int64()), "told": pa.array(told, pa.binary())})


def _met(blobs: list[bytes], ranges: int, widths: list[int], all_shared: bool):
    """(range, ids, data) of what an exchange bucket settles."""
    *keys, ids = (np.concatenate(c) for c in zip(*(_unplaned(data, [*widths, 8]) for data in blobs), strict=True))
    ids = ids.view(np.int64)
    order = np.lexsort((ids, *reversed(keys)))
    keys, ids = [k[order] for k in keys], ids[order]
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(ids)])
    least = np.repeat(ids[first], size)
    if all_shared:
        most = np.repeat(ids[np.r_[first[1:], len(ids)] - 1], size)
        told = most > least
    else:
        told = _rank(ids) > _rank(least)
    yield from _by_range(keys[0][told], ids[told], ranges, widths[0])


_SCHEMA = "bucket int, range int, ids binary, data binary"


def _rows(items) -> pa.RecordBatch:
    cols = list(zip(*items, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "range", "ids", "data"])


def _exchange(sent: DataFrame, ranges: int, widths: list[int], all_shared: bool) -> DataFrame:
    """(id, told): what each document is told. A bucket answers with one block for each range of documents, not one for each document."""

    def settle(block: pa.Table) -> pa.Table:
        fresh = pc.less(block.column("range"), 0)
        known = block.filter(pc.invert(fresh)).select(["range", "ids", "data"])
        blobs = block.filter(fresh).column("data").to_pylist()
        found = list(zip(*_met(blobs, ranges, widths, all_shared), strict=True)) if blobs else []
        met = pa.table([pa.array(c, t) for c, t in zip(found or [[], [], []], (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "ids", "data"])
        return pa.concat_tables([known, met])

    # one bucket after the other; Spark sorts them and spills
    met = sent.groupBy("bucket").applyInArrow(settle, "range int, ids binary, data binary")
    return cut(met.groupBy("range").applyInArrow(lambda block: _gathered(block, widths[0]), "id long, told binary"))


def _told(cell, width: int) -> np.ndarray:
    return _unplaned(cell.as_py(), [width])[0]


def repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = 13, bucket_mb: tuple[int, int] = (8, 32), most_small: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (the words left, one space between).

    A word goes when a window that covers it also starts in a document of smaller id.
    bucket_mb: text for one bucket of an exchange, which bounds a task's memory: the
    first up to ``most_small`` buckets, then they grow up to the second.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) - F.pmod(F.xxhash64(F.col(text_col)), F.lit(NULLS))).alias("oid"), F.col(text_col).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    small, large = (-(-total // (mb << 20)) for mb in bucket_mb)
    buckets = max(12, min(small, most_small), large)
    ranges = max(12, large)
    # a shared name only proposes windows, so it may be cut to some bits more than it takes to number all words
    name_width = min(8, -(-(int(total).bit_length() + 8) // 8))

    def names(batches):
        for b in batches:
            for held in _grouped((i, hashes_of(t.as_py()), window) for i, t in zip(b.column("oid").to_pylist(), b.column("text"), strict=True)):
                words, wall, of = _laid_out(held)
                starts, name = window_names(words, wall, window)
                ids = np.array([i for i, _ in held], np.int64)[of[starts]]
                fresh = np.r_[True, (name[1:] != name[:-1]) | (ids[1:] != ids[:-1])] if len(ids) else np.zeros(0, bool)
                yield _rows(_sent([name[fresh]], ids[fresh], buckets, ranges, True, [name_width]))

    shared = _exchange(rows.select("oid", "text").mapInArrow(forgetful(forget, names), _SCHEMA), ranges, [name_width], True)
    release(docs.sparkSession)

    def windows(batches):
        for b in batches:
            told = b.column("told")
            for held in _grouped(((k, i), hashes_of(unpacked(t)), window) for k, (i, t) in enumerate(zip(b.column("oid").to_pylist(), b.column("text"), strict=True))):
                words, wall, of = _laid_out(held)
                starts, name = window_names(words, wall, window)
                place = of[starts]
                known = {}
                some = np.zeros(len(starts), bool)
                edges = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
                for a, z in zip(edges, np.r_[edges[1:], len(place)] if len(place) else [], strict=True):
                    k = held[place[a]][0][0]
                    if k not in known:
                        known[k] = _told(told[k], name_width)
                    some[a:z] = np.isin(_low(name[a:z], name_width), known[k])
                starts, place = starts[some], place[some]
                ids = np.array([key[1] for key, _ in held], np.int64)[place]
                yield _rows(_sent([window_hash(words, starts, window, f) for f in FACTORS], ids, buckets, ranges, False, WIDTHS))

    both = packed(rows.select("oid", "text")).join(shared.withColumnRenamed("id", "oid"), "oid")
    found = _exchange(both.mapInArrow(forgetful(forget, windows), _SCHEMA), ranges, WIDTHS, False)
    release(docs.sparkSession)
    kind = rows.schema["id"].dataType.simpleString()

    def remove(batches):
        for b in batches:
            out = []
            for t, told in zip(b.column("text"), b.column("told"), strict=True):
                out.append(without(unpacked(t), _told(told, WIDTHS[0]) if told.is_valid else None, window))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], ["id", "n_words", "n_removed", "kept"])

    last = packed(rows).join(found.withColumnRenamed("id", "oid"), "oid", "left").select("id", "text", "told")
    return last.mapInArrow(forgetful(forget, remove), f"id {kind}, n_words long, n_removed long, kept string")


#: Odd factors of the two window hashes, and the bytes of each that are compared (96 bits).
WIDTHS = [8, 4]
FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def window_hash(words: np.ndarray, starts: np.ndarray, window: int, factor: int) -> np.ndarray:
    return _spans_hash(words, starts, starts + window, factor)


def without(text: str | None, told: np.ndarray | None, window: int) -> tuple[int, int, str]:
    """Words, removed words, and what is left of a text whose windows of the hashes ``told`` go."""
    if told is None:
        n, left = 0, []
        for w in words_of(text):
            n += len(w)
            left += [b" ".join(w)] if w else []
        return n, 0, b" ".join(left).decode()
    words = hashes_of(text)
    edge = np.zeros(len(words) + 1, np.int64)
    for at in range(0, max(1, len(words) - window + 1), SEGMENT):
        own = words[at : at + SEGMENT + window - 1]
        starts = np.arange(max(0, len(own) - window + 1))
        gone = at + starts[np.isin(window_hash(own, starts, window, FACTORS[0]), told)]
        edge[gone] += 1
        edge[gone + window] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    left, at = [], 0
    for w in words_of(text):
        mine = [x for x, k in zip(w, keep[at : at + len(w)].tolist(), strict=True) if k]
        left += [b" ".join(mine)] if mine else []
        at += len(w)
    return len(words), int((~keep).sum()), b" ".join(left).decode()


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS s FROM d)),
least AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, s + k AS i FROM win JOIN least USING (g) CROSS JOIN range(13) AS r(k) WHERE first_id < doc_id),
marked AS (SELECT word.doc_id, word.i, word.w, gone.i IS NOT NULL AS out FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i),
whole AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (out) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT out) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN whole ON whole.doc_id = d.doc_id
"""
