import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

from harrow.llm import chat, decontam, langid, packing, quality


def test_chat_reads_back(spark):
    rows = [(1, 0, "system", "s<|im_end|>"), (1, 1, "user", "<\\|x <\\\\|"), (1, 2, "assistant", "one <|im_start|>assistant\nno"), (1, 3, "user", None), (1, 4, "assistant", "two|<"), (2, 0, "user", "only"), (None, 1, None, "x"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "we%ird\nrole%0A", "t"), (5, None, "assistant", "z" * 200_000)]
    talks = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    examples = chat.expand(talks)
    got = {r["conv_id"]: r for r in chat.digest_of(examples).collect()}
    for k in {r[0] for r in rows}:
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == k]
        loss = "".join(t for role, t in mine if role == "assistant")
        r = got[k]
        assert r["n_turns"] == len(mine) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
    first = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r["n_turns"] for r in first] == [3, 5] and [r["complete"] for r in first] == [False, True]
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in first] == ["one <\\|im_start|>assistant\nno", "two|<"]
    assert chat.expand(talks.limit(0)).count() == 0


def test_language_is_right_on_held_out_rows(spark, tiny):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = langid.op6_language_id(spark, tiny).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1), (4, "12 !", None, 1), (None, "the dog", "en", 1), (1, "the cat and the dog", "en", 1), (6, "und der hund " * 100_000, None, 1)], "doc_id long, text string, lang string, score int")
    profiles = langid.learn(docs)
    got = sorted(((r["id"] or 0, r["lang_pred"]) for r in langid.identify(docs, profiles).collect()))
    assert got == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (6, "de")]
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"} and langid.identify(docs.limit(0), profiles).count() == 0


def test_grams_do_not_depend_on_the_stretch(monkeypatch):
    text = "Äpfel, und  zwei3 Birnen! " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "STRETCH", 17)
    parts = langid.gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_quality_on_held_out_rows(spark, tiny):
    tiny = tiny.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rows = quality.op1_quality_classifier(spark, tiny).collect()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(a == b for a, b in held) >= 0.93 * len(held)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (2, "BAD!! BAD!!", 1), (3, None, 1), (3, "", 1), (None, "good", 1), (5, "word " * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    weights = quality.train(docs, labels, bits=12)
    got = {r["id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert got[1] > got[2] and got[3] == 1 / (1 + np.exp(-float(np.float32(weights[-1])))) and len(got) == 5
    assert quality.keep_good(docs, weights, 0.0).columns == docs.columns and quality.keep_good(docs, weights, 0.0).count() == 6
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.limit(0), bits=12)).collect()} == {0.5}
    at, value = quality.features("a " * 700_000, 12)
    assert abs(float((value**2).sum()) - 1) < 1e-5


def plain_features(text, bits):
    """{bucket: value} of unit length, feature by feature: words, their shapes, and pairs of both."""
    wide = 1 << 64
    words = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", text or "")

    def shape(w):
        if w.isalpha():
            return "U" if w.isupper() and len(w) > 1 else "T" if w[0].isupper() else "l"
        return "9" if w.isdigit() else "x9" if w[0].isalnum() else f"!{w[:3]}"

    mix, counts = 0x9E3779B97F4A7C15, {}
    for k, of in enumerate(((lambda w: xxhash.xxh32_intdigest(w.encode(), 1)), (lambda w: xxhash.xxh32_intdigest(shape(w).encode(), 2)))):
        h = [of(w) for w in words]
        names = [(x + (k << 34)) * mix for x in h]
        names += [mix if k and a == b else (x * 0x85EBCA6B + y + ((k + 1) << 40)) * mix for a, b, x, y in zip(words, words[1:], h, h[1:], strict=False)]
        for n in names:
            at = n % wide >> 64 - bits
            counts[at] = counts.get(at, 0) + 1
    length = math.sqrt(sum(counts.values()))
    return {at: math.sqrt(n) / length for at, n in counts.items()}


def test_training_and_scores_match_the_plain_updates(spark):
    """Follow-the-regularised-leader, one coordinate at a time, in the same order of examples."""
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["good", "fine", "Bad", "!!", "x9", "no no"]) for _ in range(rng.randint(1, 25))) for i in range(60)}
    labels = {i: int("Bad" not in t) for i, t in texts.items() if i % 3}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    weights = quality.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), bits=10)
    bias, z, n = 1 << 10, {}, {}
    alpha, beta, l1, l2 = 3.0, 1.0, 0.0, 0.01

    def weight(j):
        if abs(z.get(j, 0.0)) <= l1:
            return 0.0
        return -(z[j] - math.copysign(l1, z[j])) / ((beta + math.sqrt(n[j])) / alpha + l2)

    for _ in range(3):
        for i in sorted(labels, key=lambda i: (xxhash.xxh32_intdigest(str(i)), labels[i])):
            x = {j: float(np.float32(v)) for j, v in plain_features(texts[i], 10).items()} | {bias: 1.0}
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - labels[i]) * v
                before = n.get(j, 0.0)
                z[j] = z.get(j, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[j]
                n[j] = before + g * g
    assert np.allclose(weights, [weight(j) if j in z else 0.0 for j in range(bias + 1)], atol=1e-4)
    for r in quality.score(docs, weights).collect():
        want = 1 / (1 + math.exp(-sum(weights[j] * v for j, v in plain_features(texts[r["id"]], 10).items()) - weights[-1]))
        assert abs(r["score"] - want) < 1e-5
    at, value = quality.heaviest(np.arange(5), np.array([1, 5, 3, 5, 2.0]), 3)
    assert at.tolist() == [1, 2, 3] and value.tolist() == [5, 3, 5]
    assert quality.score(docs.limit(0), weights).count() == 0 and quality.train(docs.limit(0), docs.limit(0).selectExpr("doc_id", "1 as quality"), bits=8).any() == False  # noqa: E712


def plain_grams(text):
    """n-grams of 1 to 3 letters of a text's words, each with a blank before and after."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    counts = {}
    padded = " " + " ".join(low.split()) + " "
    for size in (1, 2, 3):
        for k in range(len(padded) - size + 1):
            g = padded[k : k + size]
            if g == " " or size == 3 and g[1] == " ":
                continue
            counts[g] = counts.get(g, 0) + 1
    return counts


def code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


def test_languages_match_the_plain_distance(spark):
    at = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{at}/documents.parquet").filter("length(text) < 20000").select("doc_id", "text", "lang").collect()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = 60
    found = langid.identify(docs, langid.learn(docs, size=size)).collect()
    top = lambda counts: sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]
    profiles = {}
    for lang in {r["lang"] for r in rows if r["lang"]}:
        total = {}
        for r in rows:
            for g, n in plain_grams(r["text"]).items() if r["lang"] == lang else ():
                total[g] = total.get(g, 0) + n
        profiles[lang] = {g: k for k, g in enumerate(top(total))}
    text_of = {r["doc_id"]: r["text"] for r in rows}
    for r in found:
        mine = top(plain_grams(text_of[r["id"]])) if any(c.isalpha() for c in text_of[r["id"]] or "") else []
        far = {lang: sum(abs(p[g] - k) if g in p else size for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert (r["lang_pred"], round(r["score"], 9)) == ((best, round(1 - far[best] / (size * len(mine)), 9)) if mine else ("und", 0.0))


def test_ids_are_the_tokenizers_own(spark, tiny):
    tok, own = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    odd = ["İstanbul Σίσυφος it's don't WE'LL 'S", "a<|endoftext|>b <|startoftext|>c", "日本語 テキスト　x", "a\x1cb\x85c\xa0d e​f", "ﬁ café 12³ ½x", "", " ", "x!!y--z...'re're", "ǆ Ǆ ŉ ß ẞ \x00 \x7f \xad"]
    for t in odd + [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]:
        assert np.frombuffer(tok.encode(t), np.uint32).tolist() == own.encode(t, add_special_tokens=False).ids, t[:80]


def test_packing_keeps_every_id_once(spark, tiny):
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "twice"), (902, "twice"), (None, "no id"), (903, "w " * 600_000)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = packing.pack(packing.pieces(docs, public_tokenizers.path(packing.VOCABULARY)), windows_per_block=16).collect()
    windows, parts = {}, {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        parts.setdefault(r["id"], []).append(r)
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096
    total = 0
    for i, t in texts.items():
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], np.uint32)
        mine = sorted(parts[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in mine) == len(ids) * (2 if i == 902 else 1)
        for r in mine:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        total += len(ids)
    assert total / (4096 * len(windows)) > 0.95
    assert packing.pack(packing.pieces(docs.limit(0), public_tokenizers.path(packing.VOCABULARY))).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(0)
    sizes = [rng.randint(1, 512) for _ in range(900)]
    windows = packing.differencing(sizes, 60)
    assert sorted(i for w in windows for i in w) == list(range(900))
    sums = [sum(sizes[i] for i in w) for w in windows]
    assert max(sums) - min(sums) <= 12
    assert all(sum(sizes[i] for i in w) <= 4096 for w in packing.fill(sizes, 4096))


def plain_words(text):
    """Words as the operator compares them: ASCII lower case, without outer punctuation."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    bare = [re.sub(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$", b"", w) for w in low.encode().split()]
    return [w for w in bare if w]


def plain_item(text):
    """(words of a shingle, shingles of the question, shingles of the answer)."""
    words = plain_words(text)
    n = min(5, len(words))
    own = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] if n else []
    sentences = [s for s in re.findall(r"[^.!?\n]*[.!?\n]*", text or "") if plain_words(s)]
    answer = len(plain_words(sentences[-1])) if len(sentences) > 1 else max(1, len(words) // 3)
    return n, set(own[: max(1, len(words) - answer)]), set(own[max(0, len(own) - answer) :])


def plain_contaminated(texts, items, overlap=0.8):
    """(document, item) pairs by comparing every item with every text."""
    known, out = {i: plain_item(t) for i, t in items.items()}, set()
    for d, t in texts.items():
        words = plain_words(t)
        own = {n: {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} for n in {x[0] for x in known.values()} if n}
        out |= {(d, i) for i, (n, *parts) in known.items() if n and all(len(p & own[n]) >= overlap * len(p) for p in parts)}
    return out


def test_decontamination_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op8_decontamination(spark, at).collect()}
    assert got == plain_contaminated(texts, items) and len(got) >= 20


def test_decontamination_odd_rows(spark):
    item = "what is the capital of that far away land. it is the city by the sea"
    late = "Why so? because of all the many things that were said before by nobody at all"
    items = {1: item, 2: "", 3: None, 4: "tiny one", 5: item, 6: late}
    texts = {1: f"some words. {item.upper()}!! more", 2: "what is the capital of that far away land", 3: None, 4: "", 5: "tiny one", 6: "filler " * 300_000 + item, 7: item.replace("far", "near")}
    texts |= {8: "and a tiny, one more", 9: "a Tiny one. indeed", 10: "because of all the many things that were said before by nobody at all", 11: "well, why so because of all the many things that were said before by nobody at all"}
    docs = spark.createDataFrame([(k, v, k) for k, v in texts.items()], "doc_id long, text string, item_id long")
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = {(1, 1), (1, 5), (6, 1), (6, 5), (5, 4), (8, 4), (9, 4), (11, 6)}
    assert plain_contaminated(texts, items) == want
    for most in (2_000_000, 20):  # one index, or several one after the other
        assert {(r["id"], r["item_id"]) for r in decontam.contaminated(docs, tests, max_index_words=most).collect()} == want
        assert sorted(r["doc_id"] for r in decontam.clean(docs, tests, max_index_words=most).collect()) == [2, 3, 4, 7, 10]
    assert decontam.contaminated(docs, tests.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), tests).count() == 0
    repeated = spark.createDataFrame([(None, "tiny one"), (7, "tiny one"), (7, "tiny one")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["item_id"]) for r in decontam.contaminated(repeated, spark.createDataFrame([(None, "tiny one"), (2, "x")], "item_id long, text string")).collect()) == [(0, None), (7, None), (7, None)]


def test_items_in_pieces_are_found_all_over_a_text(spark):
    """Items of 30 to 120 words in 2 to 6 pieces, 200 other words between; some of them lose too much to pass."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    items, texts = {}, {}
    for i, (n, cuts) in enumerate((n, cuts) for n in (30, 60, 100, 120) for cuts in (2, 3, 4, 5, 6)):
        own = [word() for _ in range(n)]
        own[2 * n // 3] += "."
        items[i] = " ".join(own)
        at = sorted(rng.sample(range(6, n - 6), cuts - 1))
        parts = [own[a:b] for a, b in zip([0, *at], [*at, n], strict=True)]
        texts[i] = " ".join(" ".join(p) + " " + " ".join(word() for _ in range(200)) for p in parts)
        texts[100 + i] = " ".join(" ".join(p) + " " + " ".join(word() for _ in range(200)) for p in parts[1:])
    want = plain_contaminated(texts, items)
    assert 5 <= len(want) < 20, sorted(want)
    docs, tests = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    for passage, most in ((4096, 2_000_000), (64, 500)):
        assert {(r["id"], r["item_id"]) for r in decontam.contaminated(docs, tests, passage=passage, max_index_words=most).collect()} == want
        assert {r["doc_id"] for r in decontam.clean(docs, tests, passage=passage, max_index_words=most).collect()} == set(texts) - {d for d, _ in want}


def test_block_max_wand_finds_all_above_threshold():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 30)))) for i in range(300)]
    index = decontam.Index(items, 0.8)
    for _ in range(200):
        terms = sorted(set(rng.sample(list(index.lists), 6) + list(decontam.shingles(decontam.word_hashes(items[rng.randrange(300)][1])).tolist())))
        want = {}
        for t in terms:
            for k, x in zip(index.lists[t][0], index.lists[t][1], strict=True):
                want[k] = want.get(k, 0.0) + x
        assert set(index.search(terms)) == {k for k, x in want.items() if x >= index.least[k] - 1e-12}
