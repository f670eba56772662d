import hashlib
import random
import zlib
from bisect import bisect_left, bisect_right

from harrow.llm import exact_dedup, sharding

ROWS = [(1, "a b", 9), (2, "ab", 9), (3, "a  b", 9), (4, None, 9), (5, "", 9), (6, " \t\n\x0b\x0c\r", 9), (None, "ab", 9), (7, "x\xa0y", 9), (7, "x\xa0y", 9), (8, "xy", 9), (9, "q" * 300_000, 9)]


def test_exact_groups_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, digest int").repartition(5)
    for fan_in in (2, 4):
        got = {}
        for r in exact_dedup.exact_groups(docs, fan_in=fan_in).collect():
            got.setdefault(r["id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
        assert got[1] == [(3, 4, False)] and got[3] == [(3, 4, True)] and got[None] == [(3, 4, False)]
        assert got[4] == [(6, 3, False)] and got[6] == [(6, 3, True)] and got[8] == [(8, 1, True)]
        assert sorted(got[7]) == [(7, 2, False), (7, 2, True)] and got[9] == [(9, 1, True)]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 6, 7, 8, 9]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0 and exact_dedup.deduplicate(docs.limit(0)).count() == 0


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The minimax over a list in order, by brute force."""
    ends, at = [0], 0
    for s in sizes:
        ends.append(at := at + s)
    candidates = sorted({b - a for i, a in enumerate(ends) for b in ends[i + 1 :]})

    def fits(c: int) -> bool:
        p = 0
        for _ in range(shards):
            p = ends[bisect_right(ends, p + c) - 1]
        return p == at

    return candidates[bisect_left(candidates, True, key=fits)]


def check_shards(rows, texts, shards):
    """Every law of the contract, and the capacity against brute force over the same order."""
    groups = {}
    for r in rows:
        t = texts[r["id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode())
        groups.setdefault(hashlib.sha256(t.encode()).digest(), []).append(r)
    assert all(len({r["shard"] for r in g}) == 1 for g in groups.values())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards)) and all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    sizes = [sum(r["size"] for r in g) for _, g in sorted(groups.items())]
    cuts = [g[0]["shard"] for _, g in sorted(groups.items())]
    assert cuts == sorted(cuts)  # contiguous in the order of digests
    assert max(sum(r["size"] for r in x) for x in by.values()) <= smallest_capacity(sizes, shards)


def test_shards_are_minimax(spark):
    rng = random.Random(4)
    texts = {i: rng.choice("abcdefgh") * rng.choice((1, 5, 50, 700)) + (str(i) if i % 3 else "") for i in range(150)} | {1000 + i: "hot " * 40 for i in range(60)} | {2000: None, 2001: ""}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, shard int")
    for local_ends, salt in ((100_000, 50_000), (3, 20)):
        check_shards(sharding.shard(docs, 8, rows_per_salt=salt, probes=3, local_ends=local_ends).collect(), texts, 8)
    assert sharding.shard(docs.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.shard(docs.filter("doc_id >= 2000"), 8).collect()} <= set(range(8))
    odd = spark.createDataFrame([(None, "hot"), (None, "hot"), (None, "hot"), (3, "hot"), (3, "hot"), (4, None), (5, "z" * 2_000_000)], "doc_id long, text string")
    rows = sharding.shard(odd, 2, rows_per_salt=2).collect()
    assert len({r["shard"] for r in rows if r["size"] == 4}) == 1 and max(r["size"] for r in rows) == 2_000_001
    for k in range(2):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    twice = docs.filter("doc_id = 5").union(docs.filter("doc_id = 5"))
    assert sorted(r["slot"] for r in sharding.shard(twice).collect()) == [0, 1]


def test_query_holds_the_law(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = sharding.op7_sharding(spark, tiny).withColumnRenamed("doc_id", "id").collect()
    assert len(rows) == len(texts)
    check_shards(rows, texts, 8)
