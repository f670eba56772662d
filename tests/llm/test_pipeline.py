from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from harrow.llm import quality
from tests.llm.test_text_operators import plain_contaminated


def plain_shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stages_match_plain_versions(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    columns = docs.columns
    weights = quality.train(docs, quality.learnable(spark.read.parquet(f"{tiny}/labels.parquet")))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]

    def good(t):
        at, value = quality.features(t, 18)
        return 1 / (1 + np.exp(-float(weights.astype(np.float32)[at] @ value + weights[-1]))) >= 0.3

    def squeezed(t):
        return "".join(c for c in t if c not in " \t\n\x0b\x0c\r")

    def step(name, kept):
        if name == "quality_classifier":
            return {i: t for i, t in kept.items() if good(t)}
        if name == "exact_dedup":
            best = {}
            for i, t in kept.items():
                best[squeezed(t)] = min(best.get(squeezed(t), (0, 1 << 60)), (-len(t), i))
            return {i: kept[i] for _, i in best.values()}
        if name == "simhash_near_dedup":
            ids = sorted(kept)
            sets = {i: plain_shingles(kept[i]) for i in ids}
            root = {i: i for i in ids}

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for a, b in combinations(ids, 2):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[max(find(a), find(b))] = min(find(a), find(b))
            return {i: kept[i] for i in ids if find(i) == i}
        return {i: t for i, t in kept.items() if i not in {d for d, _ in plain_contaminated(kept, dict(items))}}

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tiny)
        docs = docs.cache()
        assert docs.columns == columns
        before, want = len(want), step(name, want)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want, name
        assert len(want) < before, name
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert set(pieces) == set(want)
    for i, t in want.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own.encode(t, add_special_tokens=False).ids) + 1


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names, empty tables through every stage."""
    item = "which river runs past the old mill at the end of the long valley road. it is the grey one"
    words = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, words, "x", 1), (2, words.replace(" ", "  "), "x", 1), (3, words + " more", "x", 1), (None, words + " more", "x", 1), (None, words + " more", "x", 1), (4, None, None, None), (5, "", "x", 1),
        (6, f"some talk. {item} and on", "x", 1), (7, "long " * 300_000, "x", 1), (8, "another text of its own kind", "x", 1), (8, "another text of its own kind", "x", 1), (8, "one id with two texts in it", "x", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string, id int")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = [
        [0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8],  # nothing to learn from: all score 0.5
        [2, 3, 4, 6, 7, 8, 8],  # of 1 and 2 the longer, of 3 and the rows without an id the one with an id, of 4 and 5 the smaller id
        [2, 4, 6, 7, 8, 8],  # 3 is near 2
        [2, 4, 7, 8, 8],  # 6 holds the item
    ]
    held = docs
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        held = stage(spark, held, str(tmp_path)).cache()
        assert held.columns == docs.columns and sorted(r["doc_id"] or 0 for r in held.collect()) == ids, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, str(tmp_path)).collect()
    assert {r["doc_id"] for r in pieces} == {2, 4, 7, 8} and max(r["offset"] + r["length"] for r in pieces) <= 4096
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
