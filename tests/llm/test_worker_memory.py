import re
from pathlib import Path

import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from harrow.llm import bestfit, packing
from harrow.llm.common import forgetful

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def held_mb():
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_packing_takes_texts_in_small_batches(spark):
    """A batch of whole texts is held by Spark and by the worker: 10,000 rows are too many."""

    def seen(batches):  # the size of the batch in place of a checksum
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([7] * len(b)), pa.array([len(b)] * len(b))], ["id", "length", "ids_crc32"])

    pieces = spark.range(5000).coalesce(1).mapInArrow(seen, "id long, length long, ids_crc32 long")
    for pack in (packing.pack, bestfit.pack):
        rows = pack(pieces).collect()
        assert len(rows) == 5000 and max(r["ids_crc32"] for r in rows) <= 1024
    assert spark.conf.get(KEY, None) is None
    spark.conf.set(KEY, "300")
    try:
        assert max(r["ids_crc32"] for r in packing.pack(pieces).collect()) == 300 and spark.conf.get(KEY) == "300"
    finally:
        spark.conf.unset(KEY)


def test_a_task_gives_back_what_it_freed():
    pinned = []

    def run(batches):
        for b in batches:
            blocks = [bytes(2000) for _ in range(40_000)]
            pinned.append(bytes(2000))  # above the freed blocks, so that they are not the end of the heap
            del blocks
            yield b

    before = held_mb()
    assert list(forgetful(lambda: None, run)([1])) == [1]
    assert held_mb() - before < 30


def test_remembered_words_are_bounded_and_ids_right(monkeypatch):
    path = public_tokenizers.path(packing.VOCABULARY)
    own, tok = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for name, most in (("REMEMBER", 40), ("REMEMBER_PARTS", 20), ("REMEMBER_BYTES", 2000)):
        monkeypatch.setattr(packing, name, most)
    for k in range(60):
        text = f"The same words, always: and one{k} new {'x' * k}long{k} don't café{k} " * 3
        assert list(memoryview(tok.encode(text)).cast("I")) == own.encode(text, add_special_tokens=False).ids
        held = [x for kind in (tok.words, tok.known) for x in (kind.new, kind.old)]
        assert all(len(x) <= 60 and sum(map(len, [*x, *x.values()])) <= 3500 for x in held)
    assert "always:" in tok.words.new or "always:" in tok.words.old


def test_words_of_letters_are_not_split_and_ids_are_the_vocabularys(monkeypatch):
    """Splitting words one by one took much of packing's CPU time; words of letters alone, accented ones too, are their own part."""
    tok, asked = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY)), []

    class Parts:
        @staticmethod
        def findall(word, own=tok.parts):
            asked.append(word)
            return own.findall(word)

    tok.parts = Parts
    monkeypatch.setattr(packing, "REMEMBER", 3)
    monkeypatch.setattr(packing, "REMEMBER_PARTS", 2)
    for text in ("Éclair über naïve words", "it's İstanbul x<|endoftext|>y 語 a1-b2 Straße", "über Éclair again", "", " \t"):
        assert tok.encode(text) == tok._direct(text)
    assert set(asked) == {"it's", "i̇stanbul", "a1-b2"}
