"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

Test items are indexed by their word shingles (five words). Every training text is
read passage by passage for shingles that the index has; together these are its
query, since an item may lie in a text in any number of pieces. All items whose BM25
score reaches the item's threshold are retrieved by WAND with block maxima: posting
lists lie in blocks of item numbers, each with its largest score; a pivot item is
scored only if the block maxima of the lists up to it can still reach the least
threshold, else the lists move to the end of those blocks. Retrieved pairs are
verified by overlap: an item has a question part and an answer part (its last
sentence, or its last third where it has one sentence only), and of both parts at
least ``overlap`` of the shingles must occur in the document. The question's shingles
are those that start in it, the answer's those that end in it; a shingle across both
counts for both, so neither part is ever without one.

The threshold of an item follows from that rule, so retrieval loses nothing that
verification would accept: it is what the least weighty shingles that satisfy the
rule give, for the question or for the answer, whichever is more. An item of fewer
than five words is one shingle of all its words; documents are then read in shingles
of that length as well, so it is found inside them like any other.

The index holds the test items only. It goes to the executors as a broadcast
if its items have at most ``max_index_words`` words; a larger benchmark is split
by item into as many indexes. The driver holds one of them at a time: each is
searched, its result is kept in the checkpoint folder, and it is let go.

Defined cases: null and empty texts and items match nothing; repeated items each
match; null ids of documents and of items are kept; repeated rows are reported
each; an empty table on either side gives an empty result; other columns are not
read by the search and pass through ``clean``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, forgetful, stretches, table

WORDS = 5
BLOCK = 16
REMEMBER = 200_000
#: BM25's usual constants.
K1, B = 1.2, 0.75
EDGES = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """Lower-cased word without outer punctuation to a hash, 0 if nothing is left."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBER:
            self.clear()
        bare = EDGES.sub(b"", word)
        got = self[word] = xxhash.xxh64_intdigest(bare, 11) if bare else 0
        return got


_WORDS = _Words()


def forget() -> None:
    _WORDS.clear()
_F = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    found = []
    for part in stretches(text or ""):
        w = part.encode("utf-8", "replace").translate(LOWER).split()
        found.append(np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w)))
    out = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return out[out != 0]


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of all words if there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ out >> np.uint64(31)) * _F + words[k : len(words) - n + 1 + k]
    return out


def needed(n: int, overlap: float) -> int:
    """How many of ``n`` shingles are a share of ``overlap``, one at least."""
    return max(1, math.ceil(overlap * n - 1e-9))


class Index:
    """Posting lists of the items' shingles, in blocks with their largest scores."""

    def __init__(self, items: list[tuple[int, str]], overlap: float):
        self.overlap, self.ids = overlap, [i for i, _ in items]
        words = [word_hashes(t) for _, t in items]
        every = [shingles(w) for w in words]
        #: Lengths of the items' shingles, in words.
        self.sizes = sorted({min(WORDS, len(w)) for w in words if len(w)})
        self.parts = [self._parts(t, w, s) for (_, t), w, s in zip(items, words, every, strict=True)]
        lengths = [max(1, len(s)) for s in every]
        mean = sum(lengths) / max(1, len(lengths))
        where: dict[int, list] = defaultdict(list)
        for k, s in enumerate(every):
            for term, n in Counter(s.tolist()).items():
                where[term].append((k, n))
        self.lists, weights = {}, [{} for _ in items]
        for term, found in where.items():
            idf = math.log(1 + (len(items) - len(found) + 0.5) / (len(found) + 0.5))
            scores = [idf * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[k] / mean)) for k, n in found]
            for (k, _), x in zip(found, scores, strict=True):
                weights[k][term] = x
            blocks = [(found[min(a + BLOCK, len(found)) - 1][0], max(scores[a : a + BLOCK])) for a in range(0, len(found), BLOCK)]
            self.lists[term] = ([k for k, _ in found], scores, blocks, max(scores))
        self.terms = np.sort(np.array(list(self.lists), np.uint64))
        # what an item that passes the rule scores at least
        self.least = [max((sum(sorted(w[t] for t in part)[: needed(len(part), overlap)]) for part in parts), default=0.0) * (1 - 1e-9) if w else math.inf for w, parts in zip(weights, self.parts, strict=True)]
        self.lowest = min(self.least, default=math.inf)

    @staticmethod
    def _parts(text: str | None, words: np.ndarray, own: np.ndarray) -> tuple[frozenset, frozenset]:
        """Shingles that start in the question, and shingles that end in the answer."""
        sentences = re.findall(r"[^.!?\n]*[.!?\n]*", text or "")
        sentences = [s for s in sentences if len(word_hashes(s))]
        answer = len(word_hashes(sentences[-1])) if len(sentences) > 1 else max(1, len(words) // 3)
        question = max(1, len(words) - answer)
        return frozenset(own[:question].tolist()), frozenset(own[max(0, len(own) - answer) :].tolist())

    def search(self, terms: list[int]) -> list[int]:
        """Numbers of all items that score at least their threshold, by block-max WAND."""
        lists = [self.lists[t] for t in terms]
        at, block, out = [0] * len(lists), [0] * len(lists), []
        live = list(range(len(lists)))
        while live:
            live.sort(key=lambda i: lists[i][0][at[i]])
            bound, pivot = 0.0, None
            for p, i in enumerate(live):
                bound += lists[i][3]
                if bound >= self.lowest:
                    pivot = p
                    break
            if pivot is None:
                break
            item = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            shallow = 0.0
            for i in live[: pivot + 1]:  # move the block pointers only
                blocks = lists[i][2]
                while block[i] < len(blocks) and blocks[block[i]][0] < item:
                    block[i] += 1
                shallow += blocks[block[i]][1] if block[i] < len(blocks) else 0.0
            if shallow >= self.lowest:
                total = 0.0
                for i in live[: pivot + 1]:
                    ids, scores = lists[i][0], lists[i][1]
                    while at[i] < len(ids) and ids[at[i]] < item:
                        at[i] += 1
                    if at[i] < len(ids) and ids[at[i]] == item:
                        total += scores[at[i]]
                        at[i] += 1
                if total >= self.least[item]:
                    out.append(item)
            else:
                ends = [lists[i][2][block[i]][0] for i in live[: pivot + 1] if block[i] < len(lists[i][2])]
                stop = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(live):
                    stop = min(stop, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                for i in live[: pivot + 1]:
                    ids = lists[i][0]
                    while at[i] < len(ids) and ids[at[i]] < max(stop, item + 1):
                        at[i] += 1
            live = [i for i in live if at[i] < len(lists[i][0])]
        return out

    def matches(self, text: str | None, passage: int) -> list[tuple[int, float, float]]:
        """(item id, question overlap, answer overlap) of every item in a text."""
        words = word_hashes(text)
        own = [np.zeros(0, np.uint64)]
        for size in self.sizes:
            for at in range(0, max(0, len(words) - size + 1), passage):
                found = shingles(words[at : at + passage + size - 1], size)
                own.append(found[self._known(found)])
        own = np.concatenate(own)
        if not len(own):
            return []
        candidates = self.search(np.unique(own).tolist())
        met = set(own.tolist())
        out = []
        for k in sorted(candidates):
            shares = [len(met & part) / len(part) for part in self.parts[k]]
            if all(len(met & part) >= needed(len(part), self.overlap) for part in self.parts[k]):
                out.append((self.ids[k], *shares))
        return out

    def _known(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.terms, own)
        at[at == len(self.terms)] = 0
        return self.terms[at] == own


def indexes(items: DataFrame, id_col="item_id", text_col="text", overlap: float = 0.8, max_index_words: int = 2_000_000) -> Iterator[tuple[Index, bool]]:
    """Indexes of the test items, each of ``max_index_words`` words at most, one after the other, and whether it is the only one."""
    held, n, before = [], 0, False
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id").toLocalIterator():
        size = len((r["text"] or "").split())
        if held and n + size > max_index_words:
            yield Index(held, overlap), False
            held, n, before = [], 0, True
        held.append((r["id"], r["text"]))
        n += size
    if held:
        yield Index(held, overlap), not before


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", overlap: float = 0.8, passage: int = 4096, max_index_words: int = 2_000_000) -> DataFrame:
    """One row per document and test item in it: id, item_id, question_overlap, answer_overlap."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    item_type = items.schema[item_col].dataType
    kind, item_kind = rows.schema["id"].dataType.simpleString(), item_type.simpleString()
    shape = to_arrow_type(item_type)
    found = None
    for index, only in indexes(items, item_col, "text", overlap, max_index_words):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, held=held):
            for b in batches:
                took, said = [], []
                for k, t in enumerate(b.column("text")):
                    for m in held.value.matches(t.as_py(), passage):
                        took.append(k)
                        said.append(m)
                cols = list(zip(*said, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(took, pa.int64())), pa.array(cols[0], shape), *(pa.array(c, pa.float64()) for c in cols[1:])], ["id", "item_id", "question_overlap", "answer_overlap"])

        one = rows.mapInArrow(forgetful(forget, run), f"id {kind}, item_id {item_kind}, question_overlap double, answer_overlap double")
        if not only:
            one = cut(one)
            held.unpersist()
        found = one if found is None else found.unionAll(one)
    if found is None:
        return rows.limit(0).selectExpr("id", f"cast(null as {item_kind}) as item_id", "cast(null as double) as question_overlap", "cast(null as double) as answer_overlap")
    return found


def clean(docs: DataFrame, items: DataFrame, text_col="text", item_col="item_id", overlap: float = 0.8, passage: int = 4096, max_index_words: int = 2_000_000) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay.

    With more than one index the documents are kept once, under tags, and each index
    only adds the tags of those in which it finds an item.
    """
    tag, rows, hits = "_tag", docs, None
    for index, only in indexes(items, item_col, "text", overlap, max_index_words):
        held = docs.sparkSession.sparkContext.broadcast(index)
        if not only and hits is None:
            rows = cut(docs.withColumn(tag, F.monotonically_increasing_id()))
        at_text = rows.columns.index(text_col)

        def run(batches, held=held, wanted=only, at_text=at_text):
            for b in batches:
                found = b.filter(pa.array([bool(held.value.matches(t.as_py(), passage)) != wanted for t in b.column(at_text)], pa.bool_()))
                yield found if wanted else found.select([len(found.schema) - 1])

        if only:
            return docs.mapInArrow(forgetful(forget, run), docs.schema)
        one = cut(rows.mapInArrow(forgetful(forget, run), f"{tag} long"))
        held.unpersist()
        hits = one if hits is None else hits.union(one)
    return docs if hits is None else rows.join(hits.distinct(), tag, "left_anti").drop(tag)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
