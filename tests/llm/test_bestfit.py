import random
import zlib
from array import array

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from harrow.llm import bestfit


def test_best_two_fit_replaces_the_smallest():
    # 6 + 3 leaves a gap of 1; instead of the 3 two pieces of 2 fill it
    assert sorted(sorted([6, 3, 2, 2][i] for i in b) for b in bestfit.best_two_fit([6, 3, 2, 2], 10)) == [[2, 2, 6], [3]]
    # no two pieces are better than the one
    assert sorted(sorted([7, 3, 3][i] for i in b) for b in bestfit.best_two_fit([7, 3, 3], 11)) == [[3], [3, 7]]
    assert bestfit.best_two_fit([], 10) == []
    with pytest.raises(ValueError):
        bestfit.best_two_fit([11], 10)


@pytest.mark.parametrize("mean", [3, 40, 300, 900])
def test_bins_hold_every_piece_once_and_are_few(mean):
    rng = random.Random(mean)
    sizes = [min(1000, 1 + int(rng.expovariate(1 / mean))) for _ in range(2000)]
    bins = bestfit.best_two_fit(sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and max(sum(sizes[i] for i in b) for b in bins) <= 1000
    large, least = sum(n > 500 for n in sizes), -(-sum(sizes) // 1000)
    assert len(bins) <= 1.01 * max(large, least) + 1


def lawful(rows, capacity):
    """Places are gapless from 0 in every sequence; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_levels_hold_every_piece_once(spark, monkeypatch):
    """Many small blocks: what they leave open is packed together, so few sequences more than the tokens need."""
    monkeypatch.setattr(bestfit, "MOST", 60)
    rng = random.Random(9)
    rows = [(k if k % 7 else None, 1 + int(rng.expovariate(1 / 20)) % 100, 5) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, length long, other int").repartition(3)
    got = bestfit.pack(df, 100, 4).collect()
    assert sorted(((r["id"], r["length"], r["other"]) for r in got), key=str) == sorted(rows, key=str)
    n = lawful(got, 100)
    assert n <= 1.03 * sum(r[1] for r in rows) / 100
    assert bestfit.pack(df.limit(0), 100, 4).collect() == []


def test_query_round_trip(spark, tiny, tmp_path):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    texts |= {9001: None, 9002: "", 9003: "word " * 9000, 9004: "a", 9005: "<|endoftext|> x y"}
    spark.createDataFrame([(i, t, 3, 4) for i, t in texts.items()], "doc_id long, text string, piece int, length int").write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    want = [(i, k, 4096 * k, len(x[4096 * k : 4096 * (k + 1)]), zlib.crc32(array("I", x[4096 * k : 4096 * (k + 1)]).tobytes())) for i, x in ids.items() for k in range(-(-len(x) // 4096))]
    got = bestfit.op13_best_fit_packing(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert lawful(got, 4096) <= -(-sum(map(len, ids.values())) // 4096) + 1
