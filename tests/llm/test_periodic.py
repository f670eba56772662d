import hashlib
import random
import zlib

import numpy as np
import pytest

from harrow.llm import periodic


def brute(w, exponent=4, shortest=6):
    """(start, length, period) of all runs by comparing every word with the one q words on."""
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] == w[i + q]:
                j = i
                while j + q < n and w[j] == w[j + q]:
                    j += 1
                if j - i + q >= max(shortest, exponent * q):
                    out.setdefault((i, j - i + q), q)
                i = j
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def some_text(rng):
    kind = rng.random()
    if kind < 0.3:
        return [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(0, 150))]
    if kind < 0.7:
        out = []
        for _ in range(rng.randrange(1, 8)):
            unit = [rng.randrange(rng.choice([2, 3, 5])) for _ in range(rng.randrange(1, 12))]
            out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 100)]
        return out
    unit = [rng.randrange(2) for _ in range(rng.randrange(1, 6))]
    inner = unit * rng.randrange(1, 6) + [rng.randrange(3)]
    return inner * rng.randrange(1, 9) + [rng.randrange(9) for _ in range(9)]


@pytest.mark.parametrize("tree", [10, 1 << 16])
@pytest.mark.parametrize("law", [(4, 6), (2, 2), (3, 4)])
def test_runs_equal_brute_force(monkeypatch, tree, law):
    monkeypatch.setattr(periodic, "TREE", tree)
    rng = random.Random(tree)
    for _ in range(120):
        texts = [some_text(rng) for _ in range(rng.choice([1, 3, 12]))]
        got = periodic.chunk_runs([np.array(t, np.int64) for t in texts], *law)
        assert [[tuple(x) for x in g.tolist()] for g in got] == [brute(t, *law) for t in texts]


def test_long_texts():
    """Words that never repeat, one word only, and a Fibonacci sequence, whose runs never reach four periods."""
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    got = periodic.chunk_runs([np.arange(60_000), np.zeros(60_000, np.int64), np.array(b), np.tile(np.arange(7), 9_000)])
    assert [g.tolist() for g in got] == [[], [[0, 60_000, 1]], [], [[0, 63_000, 7]]]


def expected(doc_id, text):
    w = [x for x in (text or "").encode().split()]  # bytes are split at the six blanks of the contract
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if h is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


def test_query_equals_brute_force_on_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK", 300)
    rng = random.Random(4)
    texts = [None, "", " \t\n", "one", "a a a a a a", "a a a a a", "ab ab ab " * 30, "é " * 40, "x\x1cy x\x1cy " * 9, "a b " * 3000]
    texts += [rng.choice([" ", "\n", "  "]).join(f"w{x}" for x in some_text(rng)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, "again again again again again again"), (3, "again again again again again again")]
    spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(i, t) for i, t in rows), key=str)
    assert periodic.collapse(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_collapse_keeps_first_period(spark):
    docs = spark.createDataFrame([("k", "say it say it say it say it now"), ("l", "no run here")], "doc_id string, text string")
    got = {r["id"]: r for r in periodic.collapse(docs).collect()}
    assert got["k"]["text"] == "say it now" and [tuple(r) for r in got["k"]["runs"]] == [(0, 8, 2)] and got["l"]["text"] == "no run here" and got["l"]["runs"] == []
