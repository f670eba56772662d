import hashlib
import random

import numpy as np
import pyarrow as pa

from harrow.llm import substring


def brute(texts, window=13):
    """{id: (n_words, n_removed, kept)} by comparing all windows."""
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    least = {}
    for i, w in words.items():
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if least[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_equal_windows_take_equal_names():
    rng = random.Random(5)
    for trial in range(60):
        vocabulary = [f"w{k}" for k in range(rng.choice((2, 5, 60)))]
        common = [rng.choice(vocabulary) for _ in range(rng.randint(13, 40))]
        seen = []
        for _ in range(3):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
            at = len(words)
            words += common + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
            hashes = np.append(substring.hashes_of(" ".join(words)), np.uint64(trial))
            wall = np.zeros(len(hashes), bool)
            wall[-1] = True
            starts, names = substring.window_names(hashes, wall, 13)
            assert len(starts) == len(words) - 12 and (names != 0).all()
            seen.append(dict(zip(starts.tolist(), names.tolist(), strict=True)) | {"at": at})
        for k in range(len(common) - 12):
            assert len({s[s["at"] + k] for s in seen}) == 1


def test_query_matches_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    want = {i: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, (n, gone, kept) in brute(texts).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.op5_substring_dedup(spark, tiny).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_odd_rows_and_segments(spark, monkeypatch):
    rng = random.Random(1)
    phrase = " ".join(f"p{k}" for k in range(30))
    texts = {1: None, 2: "", 3: "a " * 50, 4: "a " * 33, 5: phrase, 6: "x " + phrase + "\x0b y\x1fz", 7: " ".join(phrase.split()[5:20]), 8: phrase + " " + phrase}
    texts |= {k: " ".join(rng.choice("abc") for _ in range(60)) for k in range(9, 30)}
    docs = spark.createDataFrame([(k, t, k) for k, t in texts.items()], "doc_id long, text string, oid long").repartition(3)
    want = brute(texts)
    for segment in (substring.SEGMENT, 16):
        monkeypatch.setattr(substring, "SEGMENT", segment)
        assert {r["id"]: tuple(r)[1:] for r in substring.repeats(docs).collect()} == want
    nulls = spark.createDataFrame([(None, phrase), (5, phrase), (5, phrase)], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["n_removed"]) for r in substring.repeats(nulls).collect()) == [(0, 30), (5, 0), (5, 0)]
    assert substring.repeats(docs.limit(0)).count() == 0
    shared = " ".join(f"s{k}" for k in range(20))  # no null id is smaller than another, a number is smaller than all of them
    mixed = [(None, shared + " one"), (None, shared + " two"), (None, "three " + shared)]
    got = lambda rows: sorted((r["id"] or 0, r["n_removed"]) for r in substring.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got(mixed) == [(0, 0)] * 3 and got([*mixed, (9, shared)]) == [(0, 20)] * 3 + [(9, 0)]


def test_words_of_long_texts_are_cut_at_contract_blanks_only(spark):
    for odd in ("\u00a0", "\u3000", "\x1c", "\x85"):
        text = "x" * ((1 << 20) - 1) + odd + "y" * 10 + " z"
        row = substring.repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert (row["n_words"], row["n_removed"], row["kept"]) == (2, 0, text)


def test_an_exchange_answers_with_a_block_for_each_range_of_documents():
    rng = np.random.default_rng(3)
    ids, keys = rng.integers(0, 5_000, 40_000), substring._mixed(rng.integers(0, 6_000, 40_000).astype(np.uint64))
    blocks = [x for part in np.array_split(np.arange(len(ids)), 5) for x in substring._sent([keys[part]], ids[part], 4, 7, True, [8])]
    rows = [x for x in blocks if x[1] >= 0]
    for b in range(4):
        met = list(substring._met([data for at, of, _, data in blocks if at == b and of < 0], 7, [8], True))
        assert len(met) <= 7
        rows += [(b, *x) for x in met]
    assert len(rows) <= (5 + 4) * 7
    told = {}
    for of in range(7):
        mine = [x for x in rows if x[1] == of]
        got = substring._gathered(pa.table({"range": [of] * len(mine), "ids": [x[2] for x in mine], "data": [x[3] for x in mine]}), 8).to_pydict()
        told |= {i: set(substring._unplaned(t, [8])[0].tolist()) for i, t in zip(got["id"], got["told"], strict=True)}
    owners = {}
    for i, k in zip(ids.tolist(), keys.tolist(), strict=True):
        owners.setdefault(k, set()).add(i)
    want = {}
    for k, of in owners.items():
        for i in of if len(of) > 1 else ():
            want.setdefault(i, set()).add(k)
    assert told == want
