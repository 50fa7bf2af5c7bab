"""The pipeline's stages: on the driver's smallest tables, and each against a brute-force version on a small corpus."""

from __future__ import annotations

import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import quality
from cairn.llm.common import documents

from .test_corpus import cut_by_hand, groups_of, votes_by_hand

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    more = [(9001, None), (9002, ""), (9003, docs.first().text), (None, "a b c d e f"), (9003, docs.first().text)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema))
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        n = docs.count()
        assert 0 < n <= seen
        seen = n
        if name != "bpe":
            assert docs.columns == columns
        if name == "ngram_join":
            assert docs.where("doc_id is not null").count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert docs.where(~F.col("decodes")).count() == 0
    empty = documents(spark, SF).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def words(rng, n):
    return " ".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('klmnrst')}" for _ in range(n))


def holds(item, text):
    """Whether a text holds half of an item's words in their order: the longest common subsequence, over all of them."""
    a, b = item.lower().split(), text.lower().split()
    row = np.zeros(len(b) + 1, int)
    for w in a:
        new = row.copy()
        for k, v in enumerate(b, 1):
            new[k] = max(new[k - 1], row[k], row[k - 1] + (w == v))
        row = new
    return row[-1] >= 0.5 * len(a)


def test_stages_by_hand(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: "\n".join(words(rng, 12) + "." for _ in range(n))
    base = [text(8) for _ in range(12)]
    rows = [(i, base[i] if i < 12 else text(8)) for i in range(60)]
    rows += [(100 + i, base[i]) for i in range(3)] + [(110 + i, base[i] + "\n" + text(6)) for i in range(3)]  # copies, and copies with more behind them
    near = [w.split() for w in base[4:8]]
    rows += [(120 + i, " ".join([*w[:50], "changed", *w[51:]])) for i, w in enumerate(near)]  # other line breaks, one word changed
    rows += [(130 + i, " ".join(f"{w}$$$" for w in words(rng, 60).upper().split()) + " !!") for i in range(40)]  # junk
    items = [(1, words(rng, 30)), (2, words(rng, 24))]
    rows += [(180, text(3) + "\n" + items[0][1] + "\n" + text(3)), (181, text(2) + " " + items[1][1])]
    rows += [(190, ""), (191, None)]
    labels = [(i, 1) for i in range(12, 60)] + [(130 + i, 0) for i in range(40)]
    spark.createDataFrame([(*r, 0) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _score string")
    left = dict(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality":
            scores = votes_by_hand(left, dict(labels))
            left = {i: t for i, t in left.items() if scores[i] >= quality.GOOD}
            assert not any(130 <= i < 170 for i in left) and set(range(60)) <= set(left)
        elif name == "line_dedup":
            cut = cut_by_hand([(i, t) for i, t in left.items()], 25)
            left = {i: t for i, (t, n, gone) in cut.items() if not gone or gone < n}
            assert 101 not in left and left[111].count("\n") == 5
        elif name == "ngram_join":
            left = {i: left[i] for i, (_, c) in groups_of(list(left.items())).items() if c == i}
            assert not any(120 <= i < 124 for i in left)
        elif name == "decontaminate":
            left = {i: t for i, t in left.items() if not any(holds(x, t or "") for _, x in items)}
            assert 180 not in left and 181 not in left
        else:
            got = {r.doc_id: list(r.ids) for r in docs.collect()}
            assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in left.items()}
            assert docs.where("not decodes").isEmpty()
            continue
        assert {r.doc_id: (r.text, r.n_chars) for r in docs.collect()} == {i: (t, len(t or "")) for i, t in left.items()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_score"] and {r[0] for r in docs.select("_score").distinct().collect()} <= {"kept"}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontaminate", "bpe"]
