"""Near-duplicates of similarity 0.8 on five-word shingles against brute force."""

from itertools import combinations

import numpy as np
import pytest

from harrow.llm import near


def plain_sets(texts):
    out = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def similar_components(texts):
    """Smallest id of each component of pairs of similarity 0.8, from all pairs that share a shingle."""
    sets, holders, root = plain_sets(texts), {}, {i: i for i in texts}
    for i in sorted(sets):
        for s in sets[i] or {None}:
            holders.setdefault(s, []).append(i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = 0
    for a, b in {p for h in holders.values() for p in combinations(h, 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}, links


def got_components(spark, texts, **more):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["id"]: r["keep"]["id"] for r in near.similar_groups(docs, **more).collect()}
    return {i: found.get(i, i) for i in texts}


def hub_group(copies=200, words=400):
    """Copies with 8 words far apart changed: about 0.82 to the original, 0.68 to each other."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(words)]
    texts = {100: " ".join(base)}
    for i in range(copies):
        own = list(base)
        for k in rng.choice(np.arange(2, words, 8), 8, replace=False):
            own[k] = f"x{i}_{k}"
        texts[i if i < 100 else i + 1] = " ".join(own)
    return texts


def test_hub_group_whose_copies_are_not_similar_to_each_other(spark):
    texts = hub_group()
    want, _ = similar_components(texts)
    assert set(want.values()) == {0} and got_components(spark, texts) == want


@pytest.mark.parametrize("hot", [1, 10_000])
def test_result_does_not_depend_on_what_is_hot(spark, monkeypatch, hot):
    """Short texts around one text: one changed word parts most of them, some still link."""
    monkeypatch.setattr(near, "HOT_SHARE", hot)
    rng = np.random.default_rng(2)
    base = [f"b{k}" for k in range(30)]
    texts = {}
    for i in range(300):
        own = list(base)
        own[int(rng.integers(0, 30))] = f"e{i}"
        texts[i] = " ".join(own)
    want, links = similar_components(texts)
    assert links > 100 and len(set(want.values())) > 100 and got_components(spark, texts) == want


def test_copies_of_every_kind_are_found(spark):
    """1,200 texts and an edited copy of each: cut, extended, words changed, words swapped, a block moved."""
    rng = np.random.default_rng(3)
    texts, planted = {}, 0
    for i in range(1200):
        n = int(rng.integers(40, 160))
        own = [f"t{i}_{k}" if k % 3 else f"common{k % 50}" for k in range(n)]
        copy, kind = list(own), i % 5
        if kind == 0:
            copy = copy[: int(n * (1 - rng.uniform(0.02, 0.21)))]
        elif kind == 1:
            copy += [f"more{i}_{k}" for k in range(int(n * rng.uniform(0.02, 0.24)))]
        elif kind == 2:
            for k in rng.choice(n, max(1, n // 60), replace=False):
                copy[k] = f"new{i}_{k}"
        elif kind == 3:
            k = int(rng.integers(0, n - 1))
            copy[k], copy[k + 1] = copy[k + 1], copy[k]
        else:
            a = n // 3
            copy = copy[a:] + copy[:a]
        texts[2 * i], texts[2 * i + 1] = " ".join(own), " ".join(copy)
    want, links = similar_components(texts)
    got = got_components(spark, texts)
    assert links >= 1000 and got == want


def template_group(n, seed=5):
    """A template of 80 words between two blocks of 20, each of ten, and a word of its own in each text: 0.85 to 0.95 with the same blocks, about 0.7 with others."""
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        h, t = rng.integers(0, 10, 2)
        words = [f"h{h}_{k}" for k in range(20)] + [f"t{k}" for k in range(80)] + [f"e{t}_{k}" for k in range(20)]
        words[int(rng.integers(0, 120))] = f"own{i}"
        out[i] = " ".join(words)
    return out


def test_most_copies_of_a_template_never_meet(spark, monkeypatch):
    """Texts meet leaders of their lists, pivots, and only those others for which the pivots leave room."""
    rows = []
    call, differences = near._Verifier.__call__, near._Verifier.differences

    def counted(self, pairs):
        pairs = near.cut(pairs)
        rows.append(pairs.count())
        return call(self, pairs)

    def measured(self, pairs, shared):
        rows.append(pairs.count())
        return differences(self, pairs, shared)

    monkeypatch.setattr(near._Verifier, "__call__", counted)
    monkeypatch.setattr(near._Verifier, "differences", measured)
    took = {}
    for n in (500, 1000, 2000):
        texts = template_group(n)
        rows.clear()
        got = got_components(spark, texts)
        took[n] = sum(rows)
        print(n, rows)
        if n == 500:
            want, _ = similar_components(texts)
            assert got == want
    assert all(took[n] < min(100 * n, n * n / 10) for n in took), took


def edited_group(n, seed=6):
    """Copies of a text of 150 words with one to seven words changed anywhere: similarities on both sides of 0.8, a third to no other."""
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(n):
        words = [f"w{k}" for k in range(150)]
        for k in rng.choice(150, int(rng.integers(1, 8)), replace=False):
            words[int(k)] = f"x{rng.integers(0, 3 * n)}"
        out[i] = " ".join(words)
    return out


def test_copies_edited_all_over_meet_few_others(spark, monkeypatch):
    rows, call = [], near._Verifier.__call__

    def counted(self, pairs):
        pairs = near.cut(pairs.distinct())
        rows.append(pairs.count())
        return call(self, pairs)

    monkeypatch.setattr(near._Verifier, "__call__", counted)
    took = {}
    for n in (200,):
        texts = edited_group(n)
        rows.clear()
        got = got_components(spark, texts)
        took[n] = sum(rows)
        print(n, rows)
        if n == 200:
            want, _ = similar_components(texts)
            assert len(set(want.values())) > 20 and got == want
    assert all(took[n] < 12 * n for n in took), took


def test_equal_words_in_another_order_hide_no_copy(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(200)]
    swapped = words[:90] + [words[91], words[90]] + words[92:]
    texts = {1: " ".join(rng.permutation(words)), 2: " ".join(words), 3: " ".join(swapped)}
    other = [w if k != 50 else "new" for k, w in enumerate(rng.permutation(words).tolist())]
    texts |= {4: " ".join(other), 5: " ".join(w if k != 50 else "new" for k, w in enumerate(words))}
    want, _ = similar_components(texts)
    assert want == {1: 1, 2: 2, 3: 2, 4: 4, 5: 2}
    assert got_components(spark, texts) == want


def test_long_texts_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(near, "CHUNK", 500)
    rng = np.random.default_rng(4)
    long = rng.integers(0, 5000, 200_000).astype(str)  # over 2**20 characters
    cut = long[:170_000]
    texts = {1: " ".join(long), 2: " ".join(cut), 3: " ".join(long[:150_000]), 4: "a b c", 5: "A  b\tc"}
    assert got_components(spark, texts) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_odd_rows(spark):
    words = [f"w{k}" for k in range(300)]
    edited, text = " ".join(words[:150] + ["other"] + words[151:]), " ".join(words)
    rows = [(5, text, 1), (3, edited, 1), (4, " ".join(words[:200]), 1), (6, None, 1), (7, "", 1), (None, text, 1), (None, "quite another text of six words", 2), (8, "w1 w2", 1), (9, "W1  w2", 1), (3, "one id two texts", 1), (3, "one id two texts", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = near.deduplicate(docs)
    assert got.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in got.collect() if r["text"])
    assert kept == sorted([(3, edited), (4, " ".join(words[:200])), (0, "quite another text of six words"), (8, "w1 w2"), (3, "one id two texts"), (3, "one id two texts")])
    assert [r["doc_id"] for r in got.collect() if not r["text"]] == [6]
    assert near.deduplicate(docs.limit(0)).count() == 0
    named = docs.select(docs["doc_id"].cast("string").alias("doc_id"), "text", docs["fp"].alias("tag"))
    assert near.deduplicate(named).count() == got.count()
