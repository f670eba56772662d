"""Language identification by rank-order profiles.

A profile is the list of the ``size`` most frequent letter n-grams (1 to 3
letters, word boundaries as a blank) of a language, most frequent first. A
document's own list is compared with each profile by the out-of-place distance:
the sum over its n-grams of how far the rank is from the profile's, an absent
n-gram counting ``size``. The nearest profile wins.

Profiles are learned from a bounded sample, about ``docs_per_lang`` documents of
each language chosen by a hash of the id; every document's whole text is scored.
Only the profiles (``size`` n-grams for each language) go to the executors.

Defined cases: a null text or one without a letter is ``und`` with score 0; with
nothing to learn from every document is ``und``; rows without an id are never
learned from and not held out; repeated rows are scored each; ties go to the language that sorts
first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, table

#: Characters that are counted at once, which bounds memory for very long texts.
STRETCH = 1 << 20
BLANK = 32


@cache
def _fold() -> np.ndarray:
    """Code point to the lower-case letter it counts as, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _merge(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(counts, first)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, in order, and how often each occurs."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    letters = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not letters.any():
        return none
    y = np.zeros(len(letters) + 2, np.uint32)
    y[1:-1] = letters
    keep = np.ones(len(y), bool)
    keep[1:] = (y[1:] != 0) | (y[:-1] != 0)
    y = y[keep]
    y[y == 0] = BLANK
    found = []
    for at in range(0, len(y), STRETCH):
        u = y[at : at + STRETCH + 2].astype(np.uint64)
        own = min(STRETCH, len(y) - at)
        one, two, three = u[:own], u[: min(own, len(u) - 1)], u[: max(0, min(own, len(u) - 2))]
        two = two | u[1 : 1 + len(two)] << np.uint64(21)
        middle = u[1 : 1 + len(three)]
        three = (three | middle << np.uint64(21) | u[2 : 2 + len(three)] << np.uint64(42))[middle != BLANK]
        every = np.concatenate([one[one != BLANK], two, three])
        every.sort()
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        found.append((every[first], np.diff(np.r_[first, len(every)])))
    if len(found) == 1:
        return found[0]
    return _merge(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))


class Profiles:
    """Learned languages and their n-gram ranks."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(ranked), size
        self.grams = np.unique(np.array([g for x in ranked.values() for g in x], np.uint64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), size, np.int64)
        for k, lang in enumerate(self.langs):
            mine = np.array(ranked[lang], np.uint64)
            self.ranks[k, np.searchsorted(self.grams, mine)] = np.arange(len(mine))

    def classify(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        mine = grams[np.argsort(-counts, kind="stable")[: self.size]]
        at = np.searchsorted(self.grams, mine)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        ranks = self.ranks[:, at]
        far = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(mine)))


def learn(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", size: int = 300, docs_per_lang: int = 2000) -> Profiles:
    """Profiles from about ``docs_per_lang`` documents of each non-null language."""
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("id").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Profiles({}, size)
    steps = 1 << 20
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(-(-steps * docs_per_lang // n))).otherwise(share)
    sample = labelled.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) < share)

    def count(batches):
        held: dict[str, list] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                mine = held.setdefault(lang, [])
                mine.append(gram_counts(text))
                if len(mine) > 200:
                    mine[:] = [_merge(np.concatenate([x for x, _ in mine]), np.concatenate([x for _, x in mine]))]
        for lang, mine in held.items():
            grams, n = np.concatenate([x for x, _ in mine]), np.concatenate([x for _, x in mine])
            if len(grams):
                grams, n = _merge(grams, n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: r["rank"]):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def identify(docs: DataFrame, profiles: Profiles, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, lang_pred, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def score(batches):
        for b in batches:
            said = [profiles.classify(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["id", "lang_pred", "score"])

    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(crc_mod("doc_id", 3) != 1))
    found = identify(docs, profiles).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
