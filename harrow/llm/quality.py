"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal.

Features are word n-grams (1 and 2 words) hashed into ``2**bits`` buckets. Words
are runs of letters and digits or runs of other signs, as they stand; each also
counts once by its shape (case, digits, signs), which carries what a hashed rare
word cannot, and a word that follows itself counts as one shape pair. A text's vector is its damped counts, scaled to unit length, so a
score does not depend on how long a text is. Weights come from the
follow-the-regularised-leader update with per-coordinate rates and L1 and L2
terms; a score is the logistic of a sparse dot product.

Fitting uses a bounded sample: about ``sample`` labelled rows chosen by a hash of
the id, each with its ``most`` heaviest features, so what reaches the driver is
bounded by sample * most; scoring covers every row's whole text and all its features.
The weight vector has a fixed size, so broadcasting it is safe at any scale.

Defined cases: null and empty texts get the score of the empty vector, which is
the bias; null labels are not learned from; with nothing to learn from every
score is 0.5; repeated rows are scored each; a null id is neither learned from nor
held out (``held_out`` is false, as in the query op1); an empty table gives an
empty result; only the id and the text are read from the documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, forgetful, stretches, table

TOKEN = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+")
#: Distinct words whose hashes a worker remembers.
REMEMBER = 200_000


def _shape(token: str) -> str:
    if token.isalpha():
        return "U" if token.isupper() and len(token) > 1 else "T" if token[0].isupper() else "l"
    return "9" if token.isdigit() else "x9" if token[0].isalnum() else f"!{token[:3]}"


class _Hashes(dict):
    """Token to (hash, hash of its shape) as one number of 64 bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBER:
            self.clear()
        got = self[token] = xxhash.xxh32_intdigest(token.encode("utf-8", "replace"), 1) << 32 | xxhash.xxh32_intdigest(_shape(token).encode("utf-8", "replace"), 2)
        return got


_HASHES = _Hashes()


def forget() -> None:
    _HASHES.clear()


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted buckets of a text and their values (unit length)."""
    size = 1 << bits
    total, last, shift = None, np.zeros(0, np.uint64), np.uint64(64 - bits)
    mix = np.uint64(0x9E3779B97F4A7C15)
    for part in stretches(text or ""):
        found = TOKEN.findall(part)
        both = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
        if not len(both):
            continue
        seen = []
        for k, h in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
            chain = np.concatenate([last[k : k + 1], h]) if len(last) else h
            pair = (chain[:-1] * np.uint64(0x85EBCA6B) + chain[1:] + np.uint64(k + 1 << 40)) * mix
            if k == 0:
                again = chain[1:] == chain[:-1]
            else:
                pair[again] = mix  # a word that follows itself
            seen += [(h + np.uint64(k << 34)) * mix >> shift, pair >> shift]
        last = np.array([both[-1] >> np.uint64(32), both[-1] & np.uint64(0xFFFFFFFF)], np.uint64)
        at, n = np.unique(np.concatenate(seen), return_counts=True)
        if total is None and len(part) == len(text):
            total = at.astype(np.int64), n
            break
        if not isinstance(total, np.ndarray):
            total = np.zeros(size, np.int64)
        total[at.astype(np.int64)] += n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    if isinstance(total, np.ndarray):
        at = np.flatnonzero(total)
        total = at, total[at]
    value = np.sqrt(total[1]).astype(np.float32)
    return total[0], value / np.sqrt((value * value).sum())


def heaviest(at: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` features of largest value, in order of bucket."""
    if len(at) <= most:
        return at, value
    keep = np.sort(np.argsort(-value, kind="stable")[:most])
    return at[keep], value[keep]


class FollowTheLeader:
    """FTRL-proximal logistic regression with a bias in the last place."""

    def __init__(self, bits: int, alpha=3.0, beta=1.0, l1=0.0, l2=0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -30, 30))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", bits: int = 18, sample: int = 4000, epochs: int = 3, most: int = 8192) -> np.ndarray:
    """Weights (and the bias, last) fitted on about ``sample`` labelled documents."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    n = marks.count()
    model = FollowTheLeader(bits)
    if not n:
        return model.weights()
    steps = 1 << 20
    marks = marks.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) < F.lit(-(-steps * sample // n)))
    # the sample is bounded, but how large its ids are is left to the optimiser to see
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, "id")

    def vectors(batches):
        for b in batches:
            found = [heaviest(*features(t.as_py(), bits), most) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([x.astype(np.uint32).tobytes() for x, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["id", "label", "at", "value"])

    kind = rows.schema["id"].dataType.simpleString()
    held = [(r["id"], r["label"], np.frombuffer(r["at"], np.uint32).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in rows.select("id", "label", "text").mapInArrow(forgetful(forget, vectors), f"id {kind}, label int, at binary, value binary").collect()]
    held.sort(key=lambda r: (xxhash.xxh32_intdigest(str(r[0])), r[1]))
    for _ in range(epochs):
        for _, label, at, value in held:
            model.update(at, value, int(label > 0))
    return model.weights()


def score(docs: DataFrame, weights: np.ndarray, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: id, score in 0 to 1."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches):
        w = held.value
        for b in batches:
            out = []
            for t in b.column("text"):
                at, value = features(t.as_py(), bits)
                out.append(1 / (1 + np.exp(-float(w[at] @ value + w[-1]))))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], ["id", "score"])

    return rows.mapInArrow(forgetful(forget, run), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col="text") -> DataFrame:
    """``docs`` without the rows that score under ``threshold``; all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits = (len(weights) - 1).bit_length() - 1
    at_text = docs.columns.index(text_col)

    def run(batches):
        w = held.value
        for b in batches:
            keep = []
            for t in b.column(at_text):
                at, value = features(t.as_py(), bits)
                keep.append(1 / (1 + np.exp(-float(w[at] @ value + w[-1]))) >= threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(forgetful(forget, run), docs.schema)


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id modulo 5 is not 0."""
    return labels.filter(crc_mod("doc_id", 5) != 0)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(docs, learnable(table(spark, sf_dir, "labels")))
    found = score(docs, weights).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
