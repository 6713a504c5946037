"""Tokens as the tokenizer gives them, best fit as the textbook does it, sequences without gaps."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import packing
from tapewright.llm.queries import tokenizer_path

ODD = ["Don't I'LL they're 'S", "ΣΊΣΥΦΟΣ Σ", "İstanbul ß ẞ", "<|endoftext|>hi<|startoftext|> x", "a\xa0b c\x1cd\x85e", "é café ﬁ", "日本語 123 ½²", "😀 ok", "", " \n", "#$%&*** WORD!! a|b", "ȩ́ ́a", "can't. won't, it's", "x" * 5000, "a\x01b \x01 c", "end.of, it's. (so) 1. é."]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_are_tokenized_as_whole_texts_are(tokenizer):
    mine, want = packing.WordTokenizer(tokenizer_path(), most=8), [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]
    for _ in range(3):  # learnt, remembered, forgotten
        ids, at = mine(pa.array(ODD))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want


def test_words_of_one_hash_are_told_apart(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "range_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    mine = packing.WordTokenizer(tokenizer_path())
    texts = ["alpha bravo delta", "bravo alpha gamma gamma", "delta"]
    for _ in range(2):
        ids, at = mine(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_is_the_textbook_one():
    rng = random.Random(2)
    sizes = [rng.randrange(0, 101) for _ in range(400)]
    bins, offsets = packing.best_fit(sizes, 100)
    free: list[int] = []
    for i in sorted(range(400), key=lambda i: (-sizes[i], i)):
        fits = [b for b in free if b >= sizes[i]]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - sizes[i])
        else:
            free.append(100 - sizes[i])
    used = defaultdict(int)
    for b, s in zip(bins, sizes):
        used[b] += s
    assert sorted(used.values()) == sorted(100 - f for f in free)


def check(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_round_trip_of_packed_sequences(spark, odd, tokenizer):
    docs = odd.where("doc_id is not null and doc_id <> 1").select("doc_id", "text", "offset")
    pieces = packing.tokenize(docs, tokenizer_path(), 64, ids=True, digest=True).cache()
    placed = packing.pack(pieces, 64).cache()
    rows = placed.drop("ids").collect()
    check(rows, 64)
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(placed).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for doc, text in texts.items():
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["piece"])
        got = [t for r in own for t in seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]]
        assert got == want and [r["start"] for r in own] == list(range(0, len(want), 64))
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())


def test_words_that_end_in_a_mark_whatever_the_letter_before(tokenizer):
    """Letters whose lower case has a mark of its own, or that change under normalisation, before and after marks."""
    letters = ["İ", "i̇", "ı", "ﬁ", "ǅ", "Ǆ", "ŉ", "ẞ", "ΐ", "Σ", "é", "e\u0301", "ⅳ", "½", "²", "Å", "K", "a", "Z", "7", "日", "ก็", "\u0301", "_", "'"]
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) + rng.choice(["", ".", "!", "?!", ";", ",", ":", "'s."]) for _ in range(3)) for _ in range(10_000)]
    texts += ["İ!", "BELEDİYESİ, İ.", "DİYARBAKIRLI? İİ;"]
    ids, at = packing.WordTokenizer(tokenizer_path())(pa.array(texts))
    wrong = [t for t, a, b, w in zip(texts, at, at[1:], tokenizer.encode_batch(texts, add_special_tokens=False)) if ids[a:b].tolist() != w.ids]
    assert wrong == []


def test_sequences_of_documents_that_occur_twice(spark, tokenizer):
    texts = ["one two three", "one two three", "another text"]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2])], "doc_id long, text string")
    packed = packing.pack(packing.tokenize(docs, tokenizer_path(), 8), 8)
    want = sorted(t for text in texts for t in [*tokenizer.encode(text, add_special_tokens=False).ids, 0])
    got = packing.sequences(packed).collect()
    assert sorted(t for r in got for t in r["ids"]) == want and all(len(r["ids"]) <= 8 for r in got)


def test_no_sequence_crosses_shards(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', int(id % 90 + 1)) as text", "int(id % 5) as shard")
    rows = packing.pack(packing.tokenize(docs, tokenizer_path(), 128, ids=False, digest=True, more=("shard",)), 128, group_rows=200, within="shard").collect()
    check(rows, 128)
    of = defaultdict(set)
    for r in rows:
        of[r["sequence_id"]].add(r["shard"])
    assert all(len(x) == 1 for x in of.values()) and {s for x in of.values() for s in x} == set(range(5))


def test_few_sequences_and_odd_rows(spark, odd, empty):
    rows = packing.pack_documents(odd, tokenizer_path(), 2048).collect()
    n = check(rows, 2048)
    assert n <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    assert packing.pack_documents(empty, tokenizer_path()).count() == 0
    groups = packing.pack(packing.tokenize(odd, tokenizer_path(), 32, ids=False), 32, group_rows=50)
    check(groups.collect(), 32)
