"""A corpus pipeline of five operators: documents in, packed sequences out.

Each stage works on all that the stage before kept; all but the last return the
columns of ``documents``. Near duplicates have a similarity of 0.8 or more on
five-word shingles: SimHash proposes pairs, an exact index adds what it can't
guarantee, whole sets of shingles verify them, and of each group the document of
smallest id stays.

Defined cases: a null text is an empty text in every stage; the classifier scores
it like any other; of equal texts the longest stays, then the smallest id, null
ids last; near duplicates likewise by id; empty tables give empty results; columns
besides doc_id and text pass through the first four stages untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harrow.llm import decontam, exact_dedup, near as similar, packing, quality
from harrow.llm.common import cut, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more."""
    weights = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, weights, 0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similar.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item lies."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    pieces = packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY))
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]

#: A trained classifier and a tokenizer can't be said in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
