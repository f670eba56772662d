import random

import numpy as np
from pyspark.sql import functions as F

from harrow.operators import frontier, seen


def test_filters_know_what_they_were_made_of():
    rng = np.random.default_rng(1)
    own, other = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    f = seen.bloom(own)
    assert seen.may_know(f, own).all() and seen.may_know(f, other).mean() < 0.003 and len(f) <= 2 * len(own) + 8
    assert not seen.may_know(seen.bloom(own[:0]), own).any()


def test_unseen_is_exact_and_reads_only_folders_that_may_hold_a_url(spark, tmp_path):
    urls = lambda ks: spark.createDataFrame([(f"http://h.test/{k}", k) for k in ks], "url string, n long")
    s = seen.SeenSet(spark, str(tmp_path / "s"), folders=32)
    assert s.unseen(urls(range(5))).count() == 5
    assert s.add(urls(range(1000))).count() == 1000
    s.add(urls(range(1000, 1200)))
    got = s.unseen(urls(range(5000, 5200)))
    assert sorted(r["n"] for r in got.collect()) == list(range(5000, 5200)) and len(s.hit) <= 2  # filters alone, but for a false alarm
    assert got.columns == ["url", "n"]
    three = urls([7, 1100, 9000])
    assert [r["n"] for r in s.unseen(three).collect()] == [9000] and set(s.hit) <= {r[0] for r in three.select(F.pmod(F.xxhash64("url"), F.lit(32))).collect()}
    assert s.unseen(urls([])).count() == 0 and s.read().count() == 1200


def test_crawl_of_a_random_graph_equals_a_plain_walk(spark, monkeypatch):
    monkeypatch.setattr(frontier, "FEW", 40)  # small and large levels
    monkeypatch.setattr(seen, "BITS", 1)  # filters that often err
    rng = random.Random(3)
    graph = {k: [rng.randrange(300) for _ in range(rng.randrange(4))] for k in range(300)}
    url = lambda k: f"http://g.test/{k}"
    corpus = spark.createDataFrame([(url(k), [url(x) for x in v]) for k, v in graph.items()], "url string, links array<string>")
    pages, every = frontier.crawl(spark.createDataFrame([(url(0), 0), (url(1), 1)], "url string, seq long"), frontier.corpus_fetch(corpus), max_pages=200, max_depth=20)
    order, depth, queue, taken = [], {0: 0, 1: 0}, [0, 1], 0
    while queue and taken < 200:
        level = queue[: 200 - taken]
        order += [(d, k) for d, k in enumerate(level, 1)]
        taken += len(level)
        after = list(dict.fromkeys(x for k in level for x in graph[k] if x not in depth))
        depth |= {x: depth[level[0]] + 1 for x in after}
        queue = after if taken < 200 else []
    assert sorted((r["rank"], r["url"]) for r in pages.collect()) == sorted((d, url(k)) for d, k in order)
    assert every.select("url").distinct().count() == every.count() and every.filter("state = 'fetched'").count() == len(order)
