"""Packing whole documents by best-two-fit.

A document is its token ids and an end id. Only a document longer than a window is
cut, into pieces of one window; the last may be shorter. A bin is filled greedily,
with the largest piece that still fits its gap each time. When none fits any more,
its smallest piece gives way to two unpacked pieces that fit the gap and its place
together more tightly, the tightest two that there are, as long as that fills more.

Pieces are dealt at random into blocks of about ``windows_per_block`` windows, each
the work of one task: a mixture of lengths like any other, in which a bin rarely
keeps a gap. The bins that do (the last of a block, and the worst of each
``PASSED``) are not closed there: their pieces are dealt anew among those of other
blocks, level by level, until one block is left. So the gap that a block's end costs
is paid once for the table and not once for each block.

Piece lengths are whole numbers up to the window, so a block is a stack of pieces for
each length and one number with a bit for each length that is left; a search for
the largest piece that fits is one look at its bits.

Defined cases: a null text is an empty one and has the end id alone; repeated rows
are packed once each; null ids are kept; a very long document takes as many bins as
it needs; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, table
from .packing import VOCABULARY, pieces

#: One bin of so many is passed on to the next level, if it has a gap; a block has this number of pieces at most, about.
PASSED, MOST = 64, 250_000


class _Left:
    """Unpacked pieces by length."""

    def __init__(self, sizes: list[int]):
        self.of: dict[int, list[int]] = defaultdict(list)
        for i in range(len(sizes) - 1, -1, -1):
            self.of[sizes[i]].append(i)
        self.bits = sum(1 << n for n in self.of)

    def fitting(self, gap: int) -> int:
        """The largest length within ``gap``, 0 if there is none."""
        return max(0, (self.bits & ((2 << gap) - 1)).bit_length() - 1) if gap > 0 else 0

    def take(self, size: int) -> int:
        own = self.of[size]
        i = own.pop()
        if not own:
            self.bits ^= 1 << size
        return i

    def put(self, size: int, i: int) -> None:
        self.of[size].append(i)
        self.bits |= 1 << size

    def two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """The two lengths of largest sum within ``room``, if that is more than ``more_than``."""
        best, pair = more_than, None
        a = self.fitting(room - 1)
        while a and 2 * a > best:
            b = self.fitting(min(a, room - a))
            if b == a and len(self.of[a]) < 2:
                b = self.fitting(a - 1)
            if b and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = self.fitting(a - 1)
        return pair


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of pieces, none over ``capacity``."""
    left, bins = _Left(sizes), []
    while left.bits:
        own, gap = [], capacity
        while size := left.fitting(gap):
            own.append((size, left.take(size)))
            gap -= size
        if not own:
            raise ValueError("a piece is larger than the capacity")
        while gap and left.bits:
            k = min(range(len(own)), key=lambda j: own[j][0])
            size, i = own[k]
            pair = left.two(gap + size, size)
            if pair is None:
                break
            own[k : k + 1] = [(n, left.take(n)) for n in pair]
            left.put(size, i)
            gap += size - sum(pair)
        bins.append([i for _, i in own])
    return bins


def _placed(window: int, at_length: int, level: int, last: bool):
    """For one block: sequence_id and offset of its pieces, null where these go on to the next level."""

    def place(part: pa.Table) -> pa.Table:
        sizes = part.column(at_length).to_pylist()
        bins = best_two_fit(sizes, window)
        fill = [sum(sizes[i] for i in own) for own in bins]
        gaps = sorted((k for k in range(len(bins)) if fill[k] < window), key=fill.__getitem__)
        passed = set() if last else set(gaps[: max(1, len(bins) // PASSED)])
        base, sequence, offset = (level << 56) | (part.column("block")[0].as_py() << 24), [None] * len(sizes), [None] * len(sizes)
        for k, own in enumerate(bins):
            at = 0
            for i in own if k not in passed else ():
                sequence[i], offset[i] = base | k, at
                at += sizes[i]
        part = part.drop_columns(["block", "sequence_id", "offset"])
        return part.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return place


def pack(cut_pieces: DataFrame, window: int = 4096, windows_per_block: int = 1024) -> DataFrame:
    """``cut_pieces`` (with a column length) with sequence_id and offset, each sequence gapless from 0."""
    with small_batches(cut_pieces.sparkSession):
        rest = cut(cut_pieces.withColumns({"tag": F.monotonically_increasing_id(), "sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")}))
    shape, closed, level, blocks = rest.schema, None, 0, None
    while True:
        total, rows = rest.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
        wanted = max(1, -(-total // (window * windows_per_block)), -(-rows // MOST))
        blocks = wanted if blocks is None else min(wanted, max(1, blocks // 2))  # blocks of one bin each would pass it on for ever
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("tag", F.lit(level)), F.lit(blocks)))
        done = dealt.groupBy("block").applyInArrow(_placed(window, shape.names.index("length"), level, blocks == 1), shape)
        if blocks > 1:
            done = cut(done)
            rest, done = done.filter("sequence_id is null"), done.filter("sequence_id is not null")
        closed, level = done if closed is None else closed.unionAll(done), level + 1
        if blocks == 1:
            return closed.drop("tag")


def op13_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    window = 4096
    found = pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=1, window=window, max_piece=window), window)
    piece = F.floor(F.col("start") / window).cast("int")
    return found.select(F.col("id").alias("doc_id"), piece.alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
