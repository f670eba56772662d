"""Packing token sequences by Karmarkar-Karp multiway differencing.

A document is its token ids and an end id. It is cut into pieces: whole windows
as long as there are any, then the rest in near-equal pieces of at most
``max_piece`` tokens. Pieces of whole windows are sequences by themselves. All
others are dealt at random into blocks of about ``windows_per_block`` windows,
each block the work of one task, and distributed inside their block: every piece
starts as a partial partition into ``m`` windows, and the two partial partitions
of widest spread are merged again and again, the fullest windows of one with the
emptiest of the other, so that opposing imbalances cancel. ``m`` starts at the
fewest windows that can hold the block and rises whenever the fullest window
exceeds the capacity.

Defined cases: a null text is an empty one and has the end id alone; repeated
rows are packed once each; null ids are kept; a very long document takes as many
windows as it needs; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, stretches, table, tidied

VOCABULARY = "word_bpe_49k.json"
#: Distinct words and parts of words whose ids a worker remembers lately, and the bytes that either take; as many again are remembered from before.
REMEMBER, REMEMBER_PARTS, REMEMBER_BYTES = 150_000, 150_000, 16 << 20
#: Texts with these go to the tokenizer as they are: it may see white space otherwise than Python does.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f-\u2064\u3000\ufeff]")
#: Words of other characters than these (or that may hold an added token) go to the tokenizer as they are.
PLAIN, ADDED = re.compile(r"[\x21-\x7e\xa1-\u024f]+"), "<|"
#: Such words, joined by blanks.
PLAIN_LINE = re.compile(r"[\x20-\x7e\xa1-\u024f]+")
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids as little-endian unsigned 32-bit bytes, with a memory of words.

    The vocabulary drops white space, so a text's ids are its words' ids. A word
    is split as the vocabulary's own pre-tokenizer does and its parts go to the
    vocabulary's merges.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # byte-level vocabularies write a byte as itself if it prints, the others in order from code point 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.as_char = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.parts = regex.compile(PARTS)
        self.words, self.known = _Recent(), _Recent()

    def _direct(self, text: str) -> bytes:
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of words that are not yet in memory."""

        self.known.turn(REMEMBER_PARTS)
        if ADDED in (line := " ".join(new)) or not PLAIN_LINE.fullmatch(line):
            odd = [w for w in new if ADDED in w or not PLAIN.fullmatch(w)]
            self.words.add(odd, [self._direct(w) for w in odd])
            if len(odd) == len(new):
                return
            line = " ".join(new := list(set(new).difference(odd)))
        findall = self.parts.findall
        split = [[w] if w.isalpha() else findall(w) for w in line.lower().split(" ")]  # letters alone are one run
        bpe, ids_of = self.own.model.tokenize, self.known.new.__getitem__
        if fresh := self.known.unknown(set(chain.from_iterable(split)).difference(self.known.new)):
            seen = [p if p.isascii() else p.encode().decode("latin-1").translate(self.as_char) for p in fresh]
            self.known.add(fresh, [array("I", [t.id for t in bpe(p)]).tobytes() for p in seen])
        self.words.add(new, [ids_of(ps[0]) if len(ps) == 1 else b"".join(map(ids_of, ps)) for ps in split])

    def encode(self, text: str) -> bytes:
        out = []
        for part in stretches(text):
            if ODD_SPACE.search(part):
                out.append(self._direct(part))
                continue
            words = part.split()
            self.words.turn(REMEMBER)
            known = self.words.new
            if (new := set(words).difference(known)) and (new := self.words.unknown(new)):
                self._learn(new)
            out.append(b"".join(map(known.__getitem__, words)))
        return b"".join(out)


class _Recent:
    """Ids by word in two generations: when the new one is full it becomes the old one, and what is asked for again goes on into the next."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def turn(self, most: int) -> None:
        """Makes room if the new generation is full."""
        if len(self.new) > most or self.bytes > REMEMBER_BYTES:
            self.new, self.old, self.bytes = {}, self.new, 0

    def add(self, words: list[str], ids: list[bytes]) -> None:
        self.new.update(zip(words, ids, strict=True))
        self.bytes += sum(map(len, words)) + sum(map(len, ids))

    def unknown(self, words: set[str]) -> list[str]:
        """Those of ``words`` (not in the new generation) that the old one does not have either; the others are in the new one from here on."""
        if back := list(self.old.keys() & words):
            self.add(back, list(map(self.old.__getitem__, back)))
        return list(words.difference(back))


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_lengths(n: int, window: int, max_piece: int) -> list[int]:
    """How long the pieces of ``n`` tokens are, in order."""
    whole, rest = divmod(n, window)
    if not rest:
        return [window] * whole
    parts = -(-rest // max_piece)
    return [window] * whole + [rest // parts + (k < rest % parts) for k in range(parts)]


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Multiway differencing: the items of each of ``m`` windows, fullest window first.

    A partial partition is kept as its non-empty windows, fullest first.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    heap = [(-sizes[i], k, [(sizes[i], (i,))]) for k, i in enumerate(order)]
    heapq.heapify(heap)
    ties = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if (over := len(a) + len(b) - m) > 0:  # the last windows of a also get the last of b, opposed
            met = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - over :], reversed(b[len(b) - over :]), strict=True)]
            merged = a[: len(a) - over] + met + b[: len(b) - over]
        else:
            merged = a + b
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == m else 0)
        heapq.heappush(heap, (-spread, ties, merged))
        ties += 1
    return [list(items) for _, items in heap[0][2]] if heap else []


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows within ``capacity``: the count rises whenever it is exceeded."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, m)
        most = max((sum(sizes[i] for i in w) for w in windows), default=0)
        if most <= capacity:
            return windows
        m += 1


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, max_piece: int = 512, id_col="doc_id", text_col="text", keep_ids: bool = False) -> DataFrame:
    """Tokenized and cut documents: id, start, length, ids_crc32, doc_tokens (and ids)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = end_id.to_bytes(4, "little")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        tok = _tokenizer(tokenizer_path)
        for b in batches:
            ids = b.column("id")
            for at in range(0, len(ids), 512):
                took, starts, lengths, crcs, totals, held = [], [], [], [], [], []
                for k in range(at, min(at + 512, len(ids))):
                    data = tok.encode(b.column("text")[k].as_py() or "") + end
                    view, start, n = memoryview(data), 0, len(data) // 4
                    for length in cut_lengths(n, window, max_piece):
                        own = view[4 * start : 4 * (start + length)]
                        took.append(k)
                        starts.append(start)
                        lengths.append(length)
                        crcs.append(zlib.crc32(own))
                        totals.append(n)
                        if keep_ids:
                            held.append(bytes(own))
                        start += length
                out = [ids.take(pa.array(took, pa.int32())), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)), *[pa.array(held, pa.binary())] * keep_ids]
                yield pa.RecordBatch.from_arrays(out, ["id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    return rows.mapInArrow(tidied(run), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def pack(cut_pieces: DataFrame, window: int = 4096, windows_per_block: int = 96) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset, each sequence gapless from 0."""
    with small_batches(cut_pieces.sparkSession):
        held = cut(cut_pieces.withColumn("tag", F.monotonically_increasing_id()))
    total = held.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (window * windows_per_block)))
    held = held.withColumn("block", F.pmod(F.xxhash64("tag"), F.lit(blocks)))
    kind = held.schema["id"].dataType.simpleString()
    others = [c for c in held.columns if c not in ("id", "tag", "block")]
    schema = f"id {kind}, " + ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in others) + ", sequence_id long, offset long"

    def place(rows: pa.Table) -> pa.Table:
        sizes = rows.column("length").to_pylist()
        base = rows.column("block")[0].as_py() << 32
        rest = [i for i, n in enumerate(sizes) if n < window]
        windows = [[i] for i, n in enumerate(sizes) if n >= window] + [[rest[k] for k in w] for w in fill([sizes[i] for i in rest], window)]
        took, sequence, offset = [], [], []
        for s, w in enumerate(windows):
            at = 0
            for i in w:
                took.append(i)
                sequence.append(base | s)
                offset.append(at)
                at += sizes[i]
        out = rows.select(["id", *others]).take(pa.array(took, pa.int64()))
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return held.groupBy("block").applyInArrow(place, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
