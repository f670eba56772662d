from itertools import combinations

import numpy as np
import xxhash

from harrow.llm import simhash
from harrow.llm.common import components, stretches


def brute_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            root[find(j)] = find(i)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_every_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_split_lists_keep_every_pair():
    rng = np.random.default_rng(8)
    two = simhash._children(simhash.MASKS)
    three = simhash._children(sorted({c for _, c in two}))
    assert len({m for m, _ in two}) == 20 and len({m for m, _ in three}) == 70 and all(bin(c).count("1") == 48 for _, c in three)
    by = {}
    for m, c in two + three:
        by.setdefault(m, []).append(c)
    for _ in range(500):
        x = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        for t in (m for m in simhash.MASKS if not m & x):
            assert any(not d & x for c in by[t] if not c & x for d in by[c])


def test_fingerprint_is_the_plain_definition():
    for text in ("", " \n", "One", "a b c", "A b C d e É é", "x y z w v " * 40):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0
    long = "lorem Ipsum dolor sit amet " * 60_000
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def clusters(seed=3):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(4):
        centre = int(rng.integers(0, 1 << 63))
        for _ in range(150):
            x = centre
            for b in rng.choice(64, rng.integers(0, 7), replace=False):
                x ^= 1 << int(b)
            out.add(x)
    return sorted(out)


def test_links_match_brute_force_on_every_path(spark):
    fps = clusters()
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(signed)], "id long, fp long")
    want = dict(zip(signed, brute_components(fps, range(len(fps))), strict=True))
    for pairwise, split in ((10_000, 10_000), (4, 10_000), (64, 8), (2, 1)):
        got = {r["fp"]: r["component_id"] for r in simhash.near_groups(rows, pairwise=pairwise, split=split).collect()}
        assert got == want


def test_query_matches_brute_force(spark, tiny):
    rows = simhash.op9_simhash(spark, tiny).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in rows} == dict(zip(ids, zip(fps, brute_components(fps, ids)), strict=True))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, " ", 5), (4, "one two three", 1), (4, "one two three", 1), (5, "q w e r t y u i o p", None)], "doc_id long, text string, fp int")
    prints = simhash.fingerprints(docs)
    got = {r["fp"]: r["component_id"] for r in simhash.near_groups(prints).collect()}
    assert got[0] == 1 and sorted(got.values()) == [1, 4, 5]
    assert simhash.near_groups(prints.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.range(0, 200).selectExpr("id + 1 as a", "id as b")
    got = components(links)
    assert got.count() == 201 and got.filter("component != 0").count() == 0


def test_long_texts_are_cut_only_after_contract_blanks():
    words = ["a" * (1 << 20 >> 1), "b" * ((1 << 20 >> 1) - 2) + "\u00a0" + "c" * 30, "d", "e", "f"]
    text = " ".join(words)
    assert text[(1 << 20) - 1] == "\u00a0"
    assert [w for part in stretches(text) for w in part.encode().split()] == [w.encode() for w in words]
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_ask_little_of_the_driver(spark):
    """Every job and exchange costs the driver a plan and a thread; none goes into counting rows or into bringing a side of a join to the driver."""
    links = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    tracker, group = spark.sparkContext.statusTracker(), "components_ask_little"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = components(links)
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert {(r["node"], r["component"]) for r in got.collect()} == {(k, 0) for k in range(41)}
    assert jobs <= 60
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None
