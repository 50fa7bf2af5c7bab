"""Token counts and the BPE automaton against the library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import bpe, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = ["", " ", "a", "the cat's  hat\n\n we'll x", "x<|endoftext|>y <|endoftext|>", "Ünïcödé straße 日本語 ½² ١٢٣", "a" * 3000, "word " * 5000, "\x00\x1c\x85\xa0　|", "  \n\t ", "👩‍👩‍👧 é"]


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_operators(spark):
    rows = [(i, t, "n") for i, t in enumerate(TEXTS)] + [(None, None, "n"), (3, TEXTS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    counted = token_counts.count_tokens(docs, PATH)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = sorted((str(i), len((t or "").encode()), len(ids(t or ""))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in counted.collect()) == want
    coded = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit(1)), PATH), PATH).collect()
    assert len(coded) == len(rows)
    for r in coded:
        assert r.ids == ids(r.text or "") and r.decoded == (r.text or "")
    digest = bpe.digests(docs.where("doc_id = 4"), PATH).first()
    assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids(TEXTS[4]))).encode()).hexdigest() and digest.decoded_sha256 == hashlib.sha256(TEXTS[4].encode()).hexdigest()
    empty = docs.where("false")
    assert token_counts.count_tokens(empty, PATH).count() == bpe.digests(empty, PATH).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_files(spark, name):
    path = public_tokenizers.path(name)
    docs = spark.createDataFrame([(1, "Hello  World, hello"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()}
    if name.endswith(".json"):
        want = len(Tokenizer.from_file(path).encode("Hello  World, hello", add_special_tokens=False).ids)
    else:
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello  World, hello"))
    assert found == {1: want, 2: 0}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab 'sréß\n1½", max_size=60))
def test_any_text(text):
    assert list(memoryview(bpe.encoder(PATH).encode(text)).cast("i")) == ids(text)
    assert token_counts.counter(PATH).count([text]) == [len(ids(text))]


def test_long_words():
    """A word's time grows with its length: 400,000 letters at most 40 times as long as 20,000, with room for noise."""
    import random
    import time

    rng = random.Random(1)
    made, took = bpe.encoder(PATH).automaton, []
    for n in (20_000, 20_000, 400_000):
        word = "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
        began = time.process_time()
        found = made.path(word.encode())
        took.append(time.process_time() - began)
        assert found[:100] == ids(word)[:100] if n < 400_000 else b"".join(bpe.encoder(PATH).labels[i] for i in found) == word.encode()
    assert took[2] < 40 * max(took[1], 0.02)


def merged(word, merges):
    tokens = [bytes([b]) for b in word]
    for a, b in merges:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(tokens[i])
                i += 1
        tokens = out
    return tokens


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_automaton(data):
    """Small vocabularies: the path of a word is what the merges give, one after another."""
    known, merges = [b"a", b"b"], []
    for _ in range(data.draw(st.integers(0, 7))):
        a, b = data.draw(st.sampled_from(known)), data.draw(st.sampled_from(known))
        if a + b not in known:
            known.append(a + b)
            merges.append((a, b))
    number = {t: i for i, t in enumerate(known)}
    machine = bpe.Automaton({97: 0, 98: 1}, [(number[a], number[b], number[a + b]) for a, b in merges], dict(enumerate(known)))
    word = bytes(data.draw(st.lists(st.sampled_from(b"ab"), max_size=14)))
    assert [known[i] for i in machine.path(word)] == merged(word, merges)
