"""Secrets, periodic runs and resampling against brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import periodic, resample, secrets
from cairn.llm.queries import QUERIES

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_by_hand(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def hot_by_hand(alphabet, text):
    """Every window's entropy anew."""
    covered = set()
    for k in range(len(text) - alphabet.window + 1):
        window = text[k : k + alphabet.window]
        bits = -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())
        if bits >= alphabet.bits - 1e-7 and all(sum(c in chars for c in window) >= least for chars, least in alphabet.parts):
            covered |= set(range(k, k + alphabet.window))
    return covered


RANDOM = "xK9fQ2mZ7rTpL4vB8nWc3JhY6sDgA1eU"


@settings(max_examples=200, deadline=None)
@given(st.text("abcdef0123456789ABCxyzXYZ+/_", min_size=32, max_size=120))
def test_windows(text):
    for alphabet in secrets.ALPHABETS:
        for m in alphabet.runs.finditer(text):
            spans = alphabet.hot(m[0])
            assert {i for a, b in spans for i in range(a, b)} == hot_by_hand(alphabet, m[0])
            assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Passwd", "SECRET", "toKen", "api_key", "APIkey", '"', "'", " ", ":", "=", "hunter2hunter2", "short", "AKIA", "ABCDEFGH0123", "0123456789abcdef", "deadbeef", "é", "ſecret", "K", "\n", "a.b", "_"])))
def test_base(parts):
    text = "".join(parts)
    assert [s for s in secrets.secret_spans(text, (), None)] == base_by_hand(text)
    assert [s for s in secrets.secret_spans(text, allowed=re.compile("|".join(secrets.ALLOWED[:2]))) if s[2] in secrets.BASE] == base_by_hand(text)


def test_scan(spark):
    uuid = "123e4567-e89b-42d3-a456-426614174000"
    texts = [
        f"see {RANDOM} there",
        f"id {uuid} and sha512-{RANDOM}{RANDOM}==",
        f"token = {RANDOM}",
        "someVeryLongCamelCaseIdentifierWithoutDigits or/a/path/of/words/that/is/quite/long/indeed",
        f"EXAMPLE{RANDOM[:20]}",
        "",
        None,
        f"token = {RANDOM}",
        ("x" * 50 + " ") * 20_000 + RANDOM,
        "F3A9C0D17B2E4486AfD05c91E7b3286DFA1240CE",
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(None, f"é {RANDOM}", None)], "doc_id long, text string, secrets string")
    found = {r.doc_id: r for r in secrets.scan(docs, redacted_col="clean").collect()}
    spans = {k: [(s.kind, s.start, s.end) for s in r.secrets] for k, r in found.items()}
    assert spans[0] == [("entropy_base64", 4, 36)] and found[0].clean == "see <entropy_base64> there"
    assert not any(spans[k] for k in (1, 3, 4, 5, 6))
    assert spans[2] == spans[7] == [("assign", 0, 40)]  # what a base span holds isn't told twice
    assert spans[8] == [("entropy_base64", 51 * 20_000, 51 * 20_000 + 32)]
    assert spans[9][0][0] == "entropy_hex" and spans[None] == [("entropy_base64", 2, 34)]
    assert found[5].clean == found[6].clean == ""
    assert secrets.scan(docs.where("false")).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed_by_hand(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@st.composite
def repetitive(draw):
    w = draw(st.lists(st.sampled_from("abc"), max_size=60))
    if w:
        a, p = draw(st.integers(0, len(w) - 1)), draw(st.integers(1, 12))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        w = w * draw(st.integers(1, 4)) + draw(st.lists(st.sampled_from("ab"), max_size=20))
    return w


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4))
def test_runs(texts):
    found = periodic.runs_of_texts([[x.encode() for x in w] for w in texts])
    for w, runs in zip(texts, found, strict=True):
        assert [tuple(r) for r in runs.tolist()] == runs_by_hand(w)
        assert periodic.collapsed([x.encode() for x in w], runs).decode() == collapsed_by_hand(w, runs_by_hand(w))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=80), st.data())
def test_wavelet(values, data):
    tree = periodic.Wavelet(periodic.np.array(values))
    lo = data.draw(st.integers(0, len(values)))
    hi = data.draw(st.integers(lo, len(values)))
    bound = data.draw(st.integers(0, 100))
    one = lambda x: periodic.np.array([x])
    assert tree.below(one(lo), one(hi), one(bound))[0] == sum(v < bound for v in values[lo:hi])
    if hi > lo:
        k = data.draw(st.integers(0, hi - lo - 1))
        assert tree.smallest(one(lo), one(hi), one(k))[0] == sorted(values[lo:hi])[k]


def test_long_runs(spark):
    """Equal words, a long period, and a text without runs: all in one batch, with copies."""
    texts = ["a " * 20_000, " ".join(f"w{i % 700}" for i in range(7_000)), " ".join(f"w{i * i}" for i in range(5_000)), None, "", "one two", "x y " * 6 + "  x\x1cy"]
    docs = spark.createDataFrame([(i % len(texts), t, 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, runs int")
    found = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs.repartition(1)).collect()]
    want = {0: [(0, 20_000, 1)], 1: [(0, 7_000, 700)], 2: [], 3: [], 4: [], 5: [], 6: [(0, 12, 2)]}
    assert len(found) == 2 * len(texts) and all(runs == want[k] for k, runs, _ in found)
    assert {k: c for k, _, c in found}[6] == "x y   x\x1cy" and {k: c for k, _, c in found}[0] == "a"
    assert periodic.find_runs(docs.where("false")).count() == 0


def test_periodic_query(spark):
    docs = {r.doc_id: words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = QUERIES["op12_periodic_runs"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs) and sum(r.n_runs for r in found) > 10
    for r in found:
        w, h = docs[r.doc_id], zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = runs_by_hand(w)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        told = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(r)[1:] == (len(runs), s, n, q, n and 1000 * n // q, sha(told), sha(collapsed_by_hand(w, runs)))


def features_by_hand(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def draw_by_hand(rows, target):
    s, t = Counter(b for _, x in rows for b in features_by_hand(x)[1]), Counter(b for x in target for b in features_by_hand(x)[1])
    all_s, all_t = s.total() + 10000, t.total() + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out, may = [], []
    for doc_id, text in rows:
        n, f = features_by_hand(text)
        weight, score = sum(map(gain, f)), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            may += [(-score, doc_id)] * (n >= 20)
        out.append((doc_id, len(f), weight, score))
    drawn = sorted(may)[: 5 * len(may) // 100]
    return out, drawn


def test_resample_query(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*c).collect()]
    rows, drawn = draw_by_hand(read("documents", "doc_id", "text"), [x for (x,) in read("benchmark", "text")])
    rank = {doc_id: k for k, (_, doc_id) in enumerate(drawn, 1)}
    found = QUERIES["op13_resample"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in found if r.rank) == sorted((*x, rank[x[0]]) for x in rows if x[0] in rank) and len(rank) > 5
    assert sorted(tuple(r)[:4] for r in found) == sorted(rows)


@pytest.mark.parametrize("repeats", [1, 40])
def test_resample_edges(spark, repeats):
    long = " ".join(f"Wörd{i} X-ray" for i in range(20))
    rows = [(1, long), (2, None), (3, ""), (4, "aKb Çc 12,5"), (None, long), (None, None), (5, long + " nineteen"), *[(6, long)] * repeats, (7, "z" * 100_000 + " b" * 50_000)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, rank int")
    target = spark.createDataFrame([("wörd3 x ray",), (None,)], "text string")
    want, drawn = draw_by_hand(rows, ["wörd3 x ray", None])
    found = resample.resample(docs, target).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in found))) == sorted(map(str, want))
    assert sorted((r.rank, -r.score, r.doc_id) for r in found if r.rank) == [(k, *x) for k, x in enumerate(drawn, 1)]
    assert bool(drawn) == (repeats > 1)
    assert resample.resample(docs.where("false"), target).count() == 0


def test_radix(spark, monkeypatch):
    """More passes than digits of one key, many blocks, ties, negative numbers."""
    monkeypatch.setattr(resample, "DIGIT_BITS", 3)
    monkeypatch.setattr(resample, "BLOCK_ROWS", 7)
    rows = [((i * 37) % 100 - 50, (i * 1013) % 257 << 20) for i in range(300)] + [(5, 5)] * 40
    df = spark.createDataFrame(rows, "a long, b long")
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    for first in (None, 60, 0):
        found = sorted((r.rank, r.a, r.b) for r in resample.radix_ranks(df, [("a", True), ("b", False)], first=first).collect())
        assert found == [(k, *r) for k, r in enumerate(want[:first], 1)]
    same = resample.radix_ranks(df.where("a = 5 and b = 5"), [("a", True)]).collect()
    assert sorted(r.rank for r in same) == list(range(1, 41))
