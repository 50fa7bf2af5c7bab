"""Search, licences, decontamination, similarity join, classifier and line dedup against brute-force versions."""

from __future__ import annotations

import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import components, decontaminate, licenses, line_dedup, ngram_join, quality, search

DOCS = "doc_id long, text string, score string"


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.random() ** 2 * words)}" for _ in range(n))


# --- search


def bm25(texts, query, k):
    tf = {i: Counter(search.WORD.findall((t or "").lower())) for i, t in texts}
    n, mean = len(tf), sum(c.total() for c in tf.values()) / len(tf)
    df = Counter(w for c in tf.values() for w in c)
    out = []
    for i, c in tf.items():
        x = sum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + search.K1 * (1 - search.B + search.B * c.total() / mean)) for w in set(search.WORD.findall(query.lower())) if w in c)
        if x > 0:
            out.append((round(-x, 9), i))
    return [(i, -x) for x, i in sorted(out)[:k]]


def test_search(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 40)
    monkeypatch.setattr(search, "BLOCK", 4)
    rng = random.Random(1)
    texts = [(i, prose(rng, rng.randint(1, 60))) for i in range(150)]
    texts += [(200 + i, texts[3][1]) for i in range(5)] + [(300, None), (301, ""), (302, "only here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)
    queries = [(1, texts[3][1]), (2, texts[9][1]), (3, "only"), (4, ""), (5, None), (6, "w0 w0 w1")]
    found = search.search(docs, spark.createDataFrame(queries, "query_id long, text string"), 7).collect()
    for q, text in queries:
        got = sorted((r.rank, r.doc_id, r.score) for r in found if r.query_id == q)
        want = bm25(texts, text or "", 7)
        assert [d for _, d, _ in got] == [d for d, _ in want]
        assert all(abs(a[2] - b[1]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert search.search(docs.where("false"), docs.selectExpr("doc_id as query_id", "text")).count() == 0


def test_search_ties_and_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 8)
    monkeypatch.setattr(search, "BLOCK", 4)
    rows = [(i, "same words here", "x") for i in range(30)] + [(None, "same words here", "x"), (7, "same words here", "x"), (90, "other text", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).selectExpr("*", "'y' as terms", "1 as query_id", "2 as rank")
    asked = spark.createDataFrame([(1, "words", "c"), (1, "other", "c"), (2, "same words here", "c"), (None, "words", "c")], "query_id long, text string, doc_id string")
    found = [(r.query_id, r.rank, r.doc_id) for r in search.search(docs, asked, 5).collect()]
    assert sorted(x for x in found if x[0] == 2) == [(2, k + 1, k) for k in range(5)]
    assert sorted(x for x in found if x[0] == 1) == sorted([(1, k + 1, k) for k in range(5)] + [(1, 1, 90)]) and len(found) == 11
    many = [(r.rank, r.doc_id) for r in search.search(docs, asked.where("query_id = 2"), 40).collect()]
    assert [d for _, d in sorted(many)] == [0, 1, 2, 3, 4, 5, 6, 7, 7, *range(8, 30), None]
    assert search.search(docs, asked.where("false")).count() == 0


def shard(texts):
    """An index of texts, and their terms."""
    made = search.TermCounter()
    held = [(i, n, t, c) for i, (t, c, n) in enumerate(map(made.of, texts))]
    batch = search.packed(held)
    mean = sum(x[1] for x in held) / len(held)
    return next(search.groups(iter([batch]), mean))[0], mean


def test_blocks_are_skipped():
    rng = random.Random(2)
    texts = [" ".join([f"topic{i // 100}"] * rng.randint(3, 6) + [f"t{i // 100}x{rng.randrange(30)}" for _ in range(20)] + [f"w{rng.randrange(50)}" for _ in range(20)]) for i in range(4000)]
    index, _ = shard(texts)
    made = search.TermCounter()
    for q in range(0, 4000, 200):
        best = search.Best(5)
        terms = made.of(" ".join(texts[q].split()[3:]))[0]
        df = {t: int(index.first[k + 1] - index.first[k]) for k, t in enumerate(index.terms)}
        index.top(terms, np.array([math.log1p(4000 / (1 + df[t])) for t in terms]), best)
        scores = np.zeros(len(texts))
        for t in terms:  # all documents, with nothing skipped
            k = int(np.searchsorted(index.terms, t))
            lo, hi = index.starts[index.first[k]], index.starts[index.first[k + 1]]
            scores[index.docs[lo:hi]] += math.log1p(4000 / (1 + df[t])) * index.impacts[lo:hi]
        order = np.lexsort((index.ids, -scores))[:5]
        assert best.ids.tolist() == index.ids[order].tolist()
    assert index.blocks_scored < 0.6 * index.blocks_met


def test_cursors_pass_entries_unread():
    """Where the bar is high before a shard's last documents, pivots lie behind entries that are never looked at; the results are those of brute force."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(6000)] + ["rare words here " * 8 + " ".join(f"w{k}" for k in range(10)) for _ in range(20)]
    index, _ = shard(texts)
    best = search.Best(5)
    query = " ".join(["rare words here", *[f"w{k}" for k in range(10)]])
    terms = search.TermCounter().of(query)[0]
    df = {t: int(index.starts[index.first[k + 1]] - index.starts[index.first[k]]) for k, t in enumerate(index.terms)}
    idf = np.array([math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms])
    best.add(np.array([60.0] * 5), np.arange(-5, 0), np.zeros(5, bool))  # what shards before have given
    index.top(terms, idf, best)
    assert index.entries_read == 0 and best.ids.tolist() == [-5, -4, -3, -2, -1]
    best = search.Best(5)
    rare = np.array([t in set(search.TermCounter().of("rare words here")[0].tolist()) for t in terms])
    best.add(np.array([idf[~rare].sum() * 2.2] * 5), np.arange(-5, 0), np.zeros(5, bool))  # above all that frequent terms give
    index.top(terms, idf, best)
    assert 0 < index.entries_read < 0.1 * index.entries_met
    scores = np.zeros(len(texts))
    for t, w in zip(terms, idf, strict=True):
        k = int(np.searchsorted(index.terms, t))
        lo, hi = index.starts[index.first[k]], index.starts[index.first[k + 1]]
        scores[index.docs[lo:hi]] += w * index.impacts[lo:hi]
    assert best.ids.tolist() == index.ids[np.lexsort((index.ids, -scores))[:5]].tolist() and min(best.ids) >= 6000


def test_terms_are_those_of_the_pattern():
    """Terms are hashed by the text, not word by word; they are the pattern's words all the same."""
    made = search.TermCounter()
    letters = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert np.flatnonzero(made.in_word[[ord(c) for c in letters]]).tolist() == [m for w in search.WORD.finditer(letters) for m in range(*w.span())]
    rng = random.Random(5)
    known = {}
    for _ in range(200):
        text = "".join(rng.choice("abAB_09 éÉİß.,\n😀中ñ" + letters[rng.randrange(len(letters))]) for _ in range(rng.randrange(120)))
        words = Counter(search.WORD.findall(text.lower()))
        for w in words:
            assert known.setdefault(int(made.of(w)[0][0]), w) == w
        terms, counts, n = made.of(text)
        assert n == words.total() and {known[t]: c for t, c in zip(terms.tolist(), counts.tolist(), strict=True)} == words and (terms[1:] > terms[:-1]).all()
    assert [len(x) for x in made.of(None)[:2]] == [0, 0] and made.of(" .")[2] == 0


def test_bars_go_from_shard_to_shard(tmp_path, monkeypatch):
    """A task gives each text its k best of all shards, not of every group of them; few documents are scored in full, of copies no more than k."""
    monkeypatch.setattr(search, "GROUP_POSTINGS", 1)
    monkeypatch.setattr(search, "QUERIES", 7)
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(20, 200)) for _ in range(1200)] + ["copies of one text " + prose(rng, 40)] * 300
    rng.shuffle(texts)
    made = search.TermCounter()
    held = [(i, n, t, c) for i, (t, c, n) in enumerate(map(made.of, texts))]
    mean = sum(x[1] for x in held) / len(held)
    df = Counter(t for x in held for t in x[2].tolist())
    asked = [*range(0, 1500, 60), next(i for i, t in enumerate(texts) if t.startswith("copies"))]
    weigh = lambda t: [math.log1p((1500 - df[x] + 0.5) / (df[x] + 0.5)) for x in t]
    for k, part in enumerate((asked[:9], asked[9:])):
        terms = [held[i][2].tolist() for i in part]
        pq.write_table(pa.table({"text": pa.array([b"%d" % i for i in part]), "terms": pa.array(terms), "idf": pa.array([weigh(t) for t in terms])}), tmp_path / f"{k}.parquet")
    full = []
    scores = search.Index._scores
    monkeypatch.setattr(search.Index, "_scores", lambda self, mine, weight, docs: full.append(len(docs)) or scores(self, mine, weight, docs))
    shards = iter([search.packed(held[i : i + 300]) for i in range(0, 1500, 300)])
    found = [r for b in search.searched(shards, [str(tmp_path / "0.parquet"), str(tmp_path / "1.parquet")], mean, 5) for r in b.to_pylist()]
    assert len(found) == 5 * len(asked)
    assert sum(full) < 25 * len(asked)
    for i in asked:
        got = sorted((-r["score"], r["doc_id"]) for r in found if r["text"] == b"%d" % i)
        want = bm25(list(enumerate(texts)), texts[i], 5)
        assert [d for _, d in got] == [d for d, _ in want] and all(abs(a[0] + b[1]) < 1e-6 for a, b in zip(got, want, strict=True))


# --- licences


def test_license_variants(spark):
    """Named holders over line ends, bullets, "and" for "and/or"; rows without doc_id each by their own text."""
    known = dict(reversed([(i, t) for i, t in licenses.KNOWN if len(t) > 400]))
    bsd = next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause")
    named = bsd.replace("the copyright holder nor", "the Regents of the University\nof California nor").replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY THE REGENTS\nAND CONTRIBUTORS").replace("SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS", "SHALL THE REGENTS OR CONTRIBUTORS")
    bullets = re.sub(r"(?m)^[0-9][.] ", " - ", named)
    isc = known["ISC"].replace("and/or", "and")
    wrap = lambda t: "\n".join(f" * {x}" for p in t.split("\n") for x in textwrap.wrap(p, 60))
    rows = [(1, named), (2, bullets), (3, isc), (4, f"code\n{wrap(named)}\nmore"), (5, f"code\n{wrap(bullets)}"), (6, named.replace("MERCHANTABILITY", "SOMETHING")), *[(None, isc if k % 2 else f"own {k}") for k in range(20)]]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(licenses.KNOWN, "license_id string, text string")).collect()
    got = {r.doc_id: (r.whole_license, r.embedded_licenses) for r in found if r.doc_id}
    assert [got[k][0] for k in (1, 2, 3, 6)] == ["BSD-3-Clause", "BSD-3-Clause", "ISC", ""] and "BSD-3-Clause" in got[4][1] and "BSD-3-Clause" in got[5][1]
    assert sorted(r.whole_license for r in found if r.doc_id is None) == [""] * 10 + ["ISC"] * 10


def test_licenses(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT" and t.startswith("MIT License"))
    british = "// Copyright 2020 Someone\n# LICENSED under the Apache Licence, Version 2.0!\n"
    rows = [(1, "prose\nReleased under the MIT License.\nmore", None), (2, british, None), (3, mit.replace("<year> <holder>", "2001 Me").upper(), None), (4, None, None), (5, "", None), (6, "Released under the MIT License. And more", None), (1, "licensed under CC BY-NC 4.0", None), (None, "Licensed under CC BY 4.0.", None)]
    known = spark.createDataFrame([*licenses.KNOWN, (None, "x"), ("X", None)], "license_id string, text string")
    found = sorted(((str(r.doc_id), r.n_lines, r.n_hits, r.license_ids, r.whole_license) for r in licenses.scan(spark.createDataFrame(rows, DOCS), known).collect()))
    by = {f[0]: f for f in found}
    assert by["2"][3:] == ("Apache-2.0", "Apache-2.0") and by["3"][4] == "MIT" and by["4"][1:] == by["5"][1:] == (0, 0, "", "") and by["6"][3] == ""
    assert [f[3] for f in found if f[0] == "1"] == ["CC-BY-NC-4.0,MIT"] * 2 and by["None"][3] == "CC-BY-4.0" and len(found) == len(rows)
    assert licenses.scan(spark.createDataFrame([], DOCS), known).count() == 0


def test_licenses_inside_documents(spark):
    entire = [(i, t) for i, t in licenses.KNOWN if len(t.split()) >= 30]
    rows = []
    for k, (_, text) in enumerate(entire):
        wrapped = [line for part in text.split("\n") for line in (textwrap.wrap(part, 60) or [""])]
        rows.append((k, "\n".join(["package x;", "/* Copyright (c) 2001-2020, Some One", *(f" * {x}" for x in wrapped), " */", "", "code();"]), None))
    rows.append((100, "Permission is hereby granted to leave the room.\nNothing else", None))
    docs = spark.createDataFrame(rows, DOCS)
    long_texts = licenses.known_digests(spark.createDataFrame([("Long", " ".join(f"word{k}" for k in range(500)))], "license_id string, text string"))
    docs = docs.unionByName(spark.createDataFrame([(101, "title\n\n" + "\n".join(f"word{k} word{k + 1} word{k + 2} word{k + 3} word{k + 4}" for k in range(0, 500, 5)), None)], DOCS))
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    found = {r.doc_id: r for r in licenses.scan(docs, known, long_texts).collect()}
    for k, (name, _) in enumerate(entire):
        assert name in found[k].embedded_licenses.split(","), name
    assert found[100].embedded_licenses == "" and found[101].embedded_licenses == "Long"
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    want = {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()}
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan(docs.where("doc_id < 101"), known, spark.createDataFrame(licenses.LONG, "license_id string, head string, n_words int, digest string")).collect()}
    assert got == want


# --- decontamination

ITEM = "If Alice walks 12 miles to the old mill in 3 hours how fast does Alice walk along the river each day"
AGAIN = "They asked: If Alice walks 12 miles to the old mill in 3 hours how fast does Alice walk along the river each day, and so on."


def test_decontaminate(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "seven small words stand here alone now")], "item_id long, text string")
    other = AGAIN.replace("Alice", "Robert").replace("12", "40").replace("3 hours", "5 hours")
    uneven = AGAIN.replace("Alice walks", "Robert walks")
    rows = [(1, AGAIN, None), (2, other, None), (3, uneven, None), (4, "Plain text about the old mill and the river", None), (5, None, None), (6, "", None), (7, "x " * 3000 + AGAIN, None), (8, "So seven small words stand here alone now indeed", None), (None, AGAIN, None), (1, "clean", None)]
    found = decontaminate.scan(spark.createDataFrame(rows, DOCS), benchmark).collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in found) == sorted([("1", "1"), ("1", "1"), ("2", "1"), ("3", ""), ("4", ""), ("5", ""), ("6", ""), ("7", "1"), ("8", "4"), ("None", "")])
    assert not any(r.contaminated for r in decontaminate.scan(spark.createDataFrame(rows, DOCS), benchmark.where("false")).collect())
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows[:8]], columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame([(1, ITEM), (4, "seven small words stand here alone now")], columns=["item_id", "text"]))
    want = sorted((str(a), d) for a, _, _, d in con.execute(decontaminate.oracle()).fetchall())
    got = decontaminate.scan(spark.createDataFrame(rows[:8], DOCS), benchmark.where("item_id in (1, 4)")).collect()
    assert sorted((str(r.doc_id), r.item_ids) for r in got) == want


def item_ids(spark, texts, items):
    found = decontaminate.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    return [r.item_ids for r in sorted(found)]


def test_decontaminate_edits(spark):
    rng = random.Random(4)
    items = [" ".join(f"t{chr(97 + k)}x{chr(97 + rng.randrange(26))}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n)) for k, n in enumerate((7, 8, 9, 12, 13, 16, 17, 22, 60))]
    around = lambda words: " ".join(["words before", *words, "words after it"])
    texts, want = [], []
    for k, item in enumerate(items):
        words = item.split()
        for at in (0, len(words) // 2, len(words) - 1):
            for put in (["changed"], ["added", words[at]], []):
                if len(words) >= 9 or put:  # of 7 or 8 words all but one have to be there
                    texts.append(around(words[:at] + put + words[at + 1 :]))
                    want.append(str(k))
    long = items[-1].split()
    texts += [around(long[20:33]), around(long[:6]), around(long[:10]), around(items[0].split()[:4]), around(items[3].split()[:6]), around(items[5].split()[:8])]
    want += ["8", "", "", "", "", ""]
    assert item_ids(spark, texts, items) == want


TEMPLATES = [
    "{A} leaves {P} with {n} coins and gives {m} of them to a neighbour. On the way to {Q} the rest is lost in the river, said {A}. How many coins does {A} have when the train to {Q} arrives at night?",
    "A farmer near {P} sells {n} kg of apples and {m} liters of milk each week to {A}. If {A} pays {n} dollars for the apples, how much does {A} pay in all for the goods from {P}?",
    "Every morning {A} walks {n} miles from {P} to {Q} and rests for {m} minutes under the old oak. After a month of this, how far did {A} walk between {P} and {Q} in total?",
    "In the library of {P} there are {n} shelves with {m} books each. The clerk {A} moves half of the books to {Q}, and {A} counts the rest. What number does {A} write down for {P}?",
]
NAMES = ["Maria", "Maria Lopez", "McKay", "Jean-Luc", "O'Brien", "Anna Maria Silva", "Robert", "Li Wei"]
TOWNS = ["New York", "Berlin", "Rio de Janeiro", "Oslo", "San Sebastian", "Paris", "St-Denis", "Lima"]


def test_decontaminate_asked_again(spark):
    """Questions asked again with other numbers and names, one to three words long."""
    rng = random.Random(6)
    ask = lambda t: t.format(A=rng.choice(NAMES), P=rng.choice(TOWNS), Q=rng.choice(TOWNS), n=rng.randint(2, 900), m=rng.randint(2, 900))
    items = [ask(t) for t in TEMPLATES]
    texts = [f"{prose(rng, 30)} {ask(t)} {prose(rng, 30)}" for t in TEMPLATES for _ in range(25)]
    found = item_ids(spark, [*texts, *(prose(rng, 200) for _ in range(50))], items)
    caught = sum(str(k // 25) == x for k, x in enumerate(found[:100]))
    assert caught >= 90 and found[100:] == [""] * 50


# --- similarity join


def groups_of(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("blocks", [(64, 1024), (2, 3)])
def test_ngram_join(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngram_join, "ROWS", blocks[0])
    monkeypatch.setattr(ngram_join, "COLUMNS", blocks[1])
    rng = random.Random(7)
    base = [prose(rng, 120, 5000) for _ in range(3)]
    texts = []
    for k in range(60):  # near copies around a base that is there itself, some far from it
        words = base[k % 3].split()
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append((len(texts), " ".join(words)))
    texts += [(100 + k, base[k]) for k in range(3)] + [(110 + k, base[0]) for k in range(4)]
    chain = [f"c{k}" for k in range(100)]
    texts += [(200 + k, " ".join(chain[: 60 + 6 * k])) for k in range(6)]  # linked one to the next
    texts += [(300, ""), (301, None), (302, "one two"), (303, "ONE  two"), (304, "one two three"), (305, " \n")]
    texts += [(400 + k, "shared boiler plate line here that many hold " + prose(rng, 30, 9000)) for k in range(30)]
    found = ngram_join.jaccard_groups(spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups_of(texts)


def test_ngram_join_edges(spark):
    rows = [(5, "a b c", None), (5, "a b c", None), (None, "a b c", None), (7, "a b c", None), (None, None, None)]
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.jaccard_groups(spark.createDataFrame(rows, DOCS)).collect())
    assert found == [("5", 1, "5"), ("5", 1, "5"), ("7", 1, "5"), ("None", 0, "None"), ("None", 1, "5")]
    assert ngram_join.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_ngram_join_through_rows_without_id(spark):
    """Two documents that link to a third text alone are one group, whether that text has an id or not; such rows' own groups have none."""
    w = [f"w{k}" for k in range(104)]
    near, middle, far = w[:96], w[4:100], w[8:104]
    other = [f"o{k}" for k in range(60)]
    for third in (3, None):
        rows = [(1, " ".join(near)), (2, " ".join([*far, "end"])), (third, " ".join(middle)), (None, " ".join(other)), (None, " ".join(other)), (None, " ".join([*other, "x"]))]
        found = ngram_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        groups = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found)
        assert groups == sorted([("1", 92, "1"), ("2", 93, "1"), (str(third), 92, "1"), ("None", 56, "None"), ("None", 56, "None"), ("None", 57, "None")])


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(201, 200), (5, 5)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}


# --- classifier


def test_quality(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(rng, 40) + "." if good else " ".join(f"{w}$$$ !!" for w in prose(rng, 30).split()).upper()
        texts.append((i, text, "clash"))
        if i % 2:
            labels.append((i, int(good)))
    texts += [(400, None, None), (401, "", None), (402, "x " * 60000, None), (None, texts[0][1], None), (0, texts[0][1], None)]
    docs, known = spark.createDataFrame(texts, DOCS), spark.createDataFrame([*labels, (1, None), (None, 1), (3, 7)], "doc_id long, quality int")
    model = quality.fit(docs.drop("score"), known)
    found = quality.score(docs, model)
    assert found.columns == ["doc_id", "text", "score"] and found.count() == len(texts)
    scores = [(r.doc_id, r.score) for r in found.collect()]
    assert all(0 <= s <= 1 for _, s in scores)
    tested = [((s >= quality.GOOD) == (i % 3 > 0)) for i, s in scores if i is not None and i < 300 and i % 2 == 0]
    assert sum(tested) >= 0.97 * len(tested)
    assert {s for i, s in scores if i == 0 or i is None} == {dict(scores)[0]}
    blank = quality.fit(docs.drop("score"), known.where("false"))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def votes_by_hand(texts, labels):
    """Scores by another way: latent vectors from a singular value decomposition, every cosine on its own, the nearest sorted."""
    made = quality.Terms()

    def dense(text):
        at, v = made.of(text or "")
        out = np.zeros(quality.TERMS)
        out[at] = v
        return out

    known = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 5 and i in texts]
    sample = np.array([dense(texts[i]) for i in known], np.float32).astype(float)
    idf = np.log((1 + len(known)) / (1 + (sample > 0).sum(axis=0))) + 0.3
    sample = sample * idf
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    basis = np.linalg.svd(sample, full_matrices=False)[2][: quality.DIMENSIONS].T
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    latent = [unit(x @ basis) for x in sample]
    quota = {v: sum(labels[i] == v for i in labels if zlib.crc32(str(i).encode()) % 5) / max(1, sum(labels[i] == v for i in known)) for v in (0, 1)}
    out = {}
    for i, text in texts.items():
        own = unit((dense(text) * idf) @ basis)
        near = sorted(((float(own @ x), k) for x, k in zip(latent, known, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0.0) ** quality.POWER * quota[labels[k]], labels[k]) for c, k in near]
        total = sum(w for w, _ in votes)
        out[i] = sum(w * y for w, y in votes) / total if total > 1e-12 else sum(labels.values()) / len(labels)
    return out


def test_votes_against_brute_force(spark):
    rng = random.Random(31)
    texts = {i: (prose(rng, rng.randint(5, 60)) + "." if i % 3 else " ".join(f"{w}$$$ !!" for w in prose(rng, rng.randint(3, 30)).split()).upper()) for i in range(240)}
    labels = {i: int(i % 3 > 0) for i in range(0, 240, 2)}
    docs, known = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, known)).collect()}
    want = votes_by_hand(texts, labels)
    assert np.mean([abs(found[i] - want[i]) < 1e-3 for i in texts]) > 0.97  # neighbours at equal distance may differ
    assert all((found[i] >= quality.GOOD) == (want[i] >= quality.GOOD) for i in texts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_quality_of_held_out_documents(spark):
    """Accuracy and area under the curve on the labelled documents that nothing was learned from."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in quality.op7_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    good, bad = [s for s, _, y in rows if y], [s for s, _, y in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(rows) > 50 and auc >= 0.95 and np.mean([p == y for _, p, y in rows]) >= 0.95


# --- line dedup


def cut_by_hand(rows, least):
    """What is left of every text, and its lines and removed lines: all runs of adjacent lines against all runs of all earlier texts."""
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").split("\n")
        full = [k for k, x in enumerate(raw) if x.strip()]
        lines = [" ".join(raw[k].split()) for k in full]
        gone = set()
        for old in seen:
            for a in range(len(lines)):
                for b in range(len(old)):
                    n = 0
                    while a + n < len(lines) and b + n < len(old) and lines[a + n] == old[b + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[a : a + n]) >= least:
                        gone |= set(range(a, a + n))
        seen.append(lines)
        rest = [x for k, x in enumerate(raw) if k not in {full[g] for g in gone}]
        out[i] = (None if t is None else "" if gone and len(gone) == len(full) else "\n".join(rest), len(full), len(gone))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = [prose(rng, rng.randint(1, 30)) for _ in range(25)]
    texts = []
    for i in range(70):  # runs of a pool in any order, twice in a text at times, lines that many hold, blank lines
        lines = [rng.choice(pool) for _ in range(2)]
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(25)
            lines += [*pool[at : at + rng.randint(1, 6)], *rng.choice([[], [""], ["same short line"], [f"  {prose(rng, 5)}"]])]
        texts.append((i, "\n".join(lines)))
    texts += [(100, texts[0][1]), (101, ""), (102, None), (103, "\n \n"), (104, "long " * 60000), (105, "x\n" * 5000 + "long " * 60000)]
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts], "doc_id long, text string, n_lines string, _doc string, _places string")
    found = line_dedup.dedup_blocks(docs)
    assert found.columns == ["doc_id", "text", "_doc", "_places", "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in found.collect()} == cut_by_hand([x for x in texts if x[0] < 104], line_dedup.BLOCK_WORDS) | {104: (texts[-2][1], 1, 0), 105: ("x\n" * 4999 + "x", 5001, 1)}
    assert line_dedup.dedup_blocks(docs.where("false")).count() == 0


def test_line_dedup_scattered_holders(spark):
    rng = random.Random(9)
    head, foot = "a heading that many hold", "a footer that many hold"
    body = [prose(rng, 10, 90000) for _ in range(40)]
    copied = "\n".join([head, *body, foot])
    apart = "\n".join(x for line in body[::2] for x in (line, prose(rng, 6, 90000)))
    moved = "\n".join([*body[20:], *body[:20]])
    texts = [(1, apart), (2, f"{head}\n{prose(rng, 40, 90000)}\n{foot}"), (3, copied), (4, copied), (5, f"{copied}\nnew"), (6, moved), (8, None), (9, ""), (10, f"{head}\nnothing else\n{foot}")]
    found = {r.doc_id: r for r in line_dedup.dedup_blocks(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert found[4].text == found[6].text == "" and found[5].text == "new" and found[8].text is None
    assert all(found[i].n_removed == 0 for i in (1, 2, 3, 9, 10))


def test_line_dedup_edges(spark):
    long = prose(random.Random(1), 60)
    rows = [(1, long), (1, long), (None, long), (2, f"{long}\nown words"), (1, f"{long}\nmore")] + [(None, f"{long}\n{k}") for k in range(30)]
    found = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = [t for d, t in found if d == "1"]
    assert ("None", "") in found and ("2", "own words") in found and len(found) == 35
    assert {("None", str(k)) for k in range(30)} < set(found)
    assert sorted(kept) in (sorted([long, long, "more"]), sorted(["", "", f"{long}\nmore"]))


def test_alignment_alone_deletes(spark, monkeypatch):
    """Without alignment nothing goes; with its first turn alone, moved and repeated blocks stay."""
    rng = random.Random(4)
    body = [prose(rng, 12, 90000) for _ in range(20)]
    texts = [(1, "\n".join(body)), (2, "\n".join([*body[10:], "own line", *body[:10]])), (3, "\n".join([*body[:4], *body[:4]])), (4, "own text " * 20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    removed = lambda: {r.doc_id: r.n_removed for r in line_dedup.dedup_blocks(docs).collect()}
    assert removed() == {1: 0, 2: 20, 3: 8, 4: 0}
    hashes, words = line_dedup.lines_of(texts[0][1])
    later = line_dedup.lines_of(texts[1][1])
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "increasing", lambda values: [])
        m.setattr(line_dedup, "runs_held", lambda *x: [])
        assert line_dedup.blocks(hashes, *later, 25) == []
    with monkeypatch.context() as m:
        m.setattr(line_dedup, "runs_held", lambda *x: [])
        assert len(line_dedup.blocks(hashes, *later, 25)) == 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40), st.lists(st.integers(0, 9), max_size=40), st.sampled_from([0, 1, 8]))
def test_blocks_of_a_pair(theirs, lines, turns):
    """All common runs of enough words, whatever their order and however often they stand there."""
    words = lambda x: [3 + v for v in x]
    want = set()
    for a in range(len(lines)):
        for b in range(len(theirs)):
            n = 0
            while a + n < len(lines) and b + n < len(theirs) and lines[a + n] == theirs[b + n]:
                n += 1
            if sum(words(lines[a : a + n])) >= 25:
                want |= set(range(a, a + n))
    before, line_dedup.TURNS = line_dedup.TURNS, turns
    try:
        assert line_dedup.blocks(theirs, lines, words(lines), 25) == sorted(want)
    finally:
        line_dedup.TURNS = before


def test_line_dedup_hot_holder(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_PAIRS", 10)
    passage = "\n".join(prose(random.Random(2), 15, 90000) for _ in range(4))
    texts = [(i, f"head {i}\n{passage}\n{prose(random.Random(i), 9, 90000)}") for i in range(200)]
    found = line_dedup.dedup_blocks(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in found} == {(i, 4 if i else 0) for i in range(200)}


def test_alignment():
    assert line_dedup.increasing([3, 1, 2, 5, 4, 6]) in ([1, 2, 4, 5], [1, 2, 3, 5])
    assert line_dedup.aligned([1, 2, 2, 3, 9, 4], [7, 1, 2, 2, 3, 4]) == [(1, 5), (5, 6)]
    assert line_dedup.spans([10, 20, 3, 30], 25) == {(0, 2), (0, 3), (1, 4), (2, 4), (3, 4)}
