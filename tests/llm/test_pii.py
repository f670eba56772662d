import hashlib
import random
import re

import pytest

from harrow.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], want, r)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x.startswith(k) for x in want) for k in pii.KINDS]
        assert set(want) <= set(r["spans"].split(","))  or not want
    assert len(rows) == len(texts)


def test_query_matches_brute_force(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    check(pii.op10_pii(spark, tiny).collect(), texts)


def test_odd_texts(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "a@b.c_d@e.f x@y a@b.com@d.org", "1.2.3.4.5.6.7.8 256.1.1.1 00000255.1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112", "a@b.co  9.9.9.9 \U0001f600 z@q.de", "+1 (743) 555-3824 +12 +1234567890123456 ++44 20 7946 0958.", "1" * 60_000, "a" * 60_000 + "@", "1 " * 40_000, "a.b-c@" * 3000, "call me: (743) 555-1234 today", "write to joe [at] site [dot] org"]
    texts += ["".join(rng.choice("ab1290 .-+()@@_\n%é") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as id", "1 as tag")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op10_pii(spark, str(tmp_path)).collect()
    check(got, dict(enumerate(texts)))
    spans = {r["doc_id"]: r["spans"] for r in got}
    assert spans[11] == "phone:9:23" and spans[12] == "email:9:32"
    assert pii.find(rows.limit(0)).count() == 0


def test_reliabilities_find_the_bad_labeler():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        truth = rng.random() < 0.6
        v = tuple((1 if (truth if rng.random() < p else not truth) else -1) for p in (0.95, 0.9, 0.5, 0.85))
        counts[v] = counts.get(v, 0) + 1
    share, table, post = pii.reliabilities(counts)
    assert abs(share - 0.6) < 0.05 and abs(table[2][1][1] - 0.5) < 0.06 and table[0][1][1] > 0.9
    assert post[(1, 1, -1, 1)] > 0.95 and post[(-1, -1, 1, -1)] < 0.05


@pytest.mark.parametrize(("cues", "least"), [(True, 0.9), (False, 0.8)])
def test_added_spans_are_right_and_many(spark, cues, least):
    """Planted spans of the added kinds among look-alikes, with words of their context and without: precision and recall of what the method adds."""
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    filler = lambda: " ".join("".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(8, 30)))

    def iban(ok):
        bare = f"{rng.randint(10**17, 10**18 - 1)}"
        check = 98 - int(bare + "131400") % 97
        return f"DE{(check if ok else (check + 5) % 97):02d}{bare}"

    true = [
        ("secret", lambda: ('token = "', hexes(40), '"')), ("secret", lambda: ("api_key: ", "sk-" + hexes(32), "")), ("secret", lambda: ("password ", "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)), "")),
        ("iban", lambda: ("IBAN ", iban(True), "")), ("ssn", lambda: ("SSN ", f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "")),
        ("name", lambda: ("Dear ", f"Dr. {rng.choice(['Anna', 'Paul', 'Maria'])} {rng.choice(['Smith', 'Keller', 'Moreau'])}", "")), ("phone", lambda: ("call ", f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", "")),
    ]
    false = [
        lambda: ("commit ", hexes(40), ""), lambda: ("see ", "a-very-long-path-of-words-that-is-no-key-1", ""), lambda: ("order ", iban(False), ""), lambda: ("part ", f"000-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ""),
        lambda: ("version ", f"{rng.randint(1, 9)}.{rng.randint(1, 9)}", ""), lambda: ("at ", f"{rng.randint(1, 9)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ""),
    ]
    texts, want = [], []
    for i in range(900):
        kind, make = true[i % len(true)] if i % 3 else ("", false[i // 3 % len(false)])
        before, value, after = make()
        head = filler() + " " + (before if cues else "")
        texts.append(head + value + after + " " + filler())
        want.append({f"{kind}:{len(head)}:{len(head) + len(value)}"} if kind else set())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = [*pii.KINDS, *pii.ADDED]
    got = {r["id"]: {f"{names[s['k']]}:{s['start']}:{s['end']}" for s in r["spans"] if not s["base"]} for r in pii.find(docs).collect()}
    hit = sum(len(got[i] & w) for i, w in enumerate(want))
    said, planted = sum(map(len, got.values())), sum(map(len, want))
    by_kind = {k: (sum(len(got[i] & w) for i, w in enumerate(want) if w and next(iter(w)).startswith(k)), sum(1 for w in want if w and next(iter(w)).startswith(k))) for k in names}
    print(f"cues {cues}: recall {hit / planted:.3f}, precision {hit / said:.3f}", by_kind)
    assert hit >= least * planted and hit >= least * said, (hit, planted, said, by_kind)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "mail a@b.com"), (None, "mail a@b.com"), (3, "mail a@b.com"), (3, "mail a@b.com"), (4, None)]
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"] or 0, len(r["spans"])) for r in got) == [(0, 1), (0, 1), (3, 1), (3, 1), (4, 0)]


def test_many_spans_in_one_text(spark, tmp_path):
    text = " ".join(f"u{k}@mail{k % 97}.com +1 415 555 {k % 10000:04d}" for k in range(15_000))
    spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(pii.op10_pii(spark, str(tmp_path)).collect(), {1: text, 2: "none"})
