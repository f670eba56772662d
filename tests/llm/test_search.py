import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from harrow.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    """docs and items: lists of (id, text); a list of (score, id) for each item."""
    counts = [(i, Counter(split(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    big_n, big_l = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for _, text in items:
        scores = []
        for i, c, n in counts:
            m = 100 - 25 + (25 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in split(text) if t in c)
            if s > 0:
                scores.append((s, i))
        out.append(sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k])
    return out


def test_varints():
    values = np.array([0, 1, 127, 128, 300, 1 << 20, 1 << 40, (1 << 62) - 1], np.int64)
    data, ends = search.varints(values)
    assert search.read_varints(data.tobytes()).tolist() == values.tolist() and ends[-1] == len(data)
    assert search.read_varints(b"").tolist() == []


@pytest.mark.parametrize("shard,block,most", [(1 << 22, 4096, 1_000_000), (40, 3, 12)])
def test_equals_brute_force(spark, monkeypatch, shard, block, most):
    """Odd rows, ties, many shards and blocks of queries; what the full index and one of the queries' terms find."""
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(shard)
    words = [f"w{k}" for k in range(30)] + ["É", "straße", "x9", "Ⅷ"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for k in range(150)]
    docs += [(None, "w1 w2"), (None, None), (500, ""), (501, None), (502, " .,!\x7f"), (503, "W1-w2_w3"), (503, "W1-w2_w3"), (504, "w4 " * 5000)] + [(600 + k, "w5 w6 w7") for k in range(50)]
    rng.shuffle(docs)
    items = [(1, "w1 w2 w2"), (2, "w5 W6"), (3, None), (4, ""), (5, "nowhere"), (None, "w9 É"), (1, "w1 w2 w2"), (6, " ".join(words) * 3), (7, "w4")]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, id string, ids int").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, score int").coalesce(1)
    want = sorted(((i, r, d_, s) for (i, _), best in zip(items, brute(docs, items), strict=True) for r, (s, d_) in enumerate(best, 1)), key=str)
    full = search.search(search.build(d), q, max_query_words=most).select("item_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, full), key=str) == want
    part = search.search(search.build(d, only=search.query_terms(q)), q, max_query_words=most).collect()
    assert sorted(map(tuple, part), key=str) == want
    assert search.query_terms(q, most=3) is None


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build(d.limit(0)), q).collect() == []
    assert search.search(search.build(d), q.limit(0)).collect() == []
    assert search.search(search.build(d), q).columns == ["item_id", "rank", "id", "score"]
