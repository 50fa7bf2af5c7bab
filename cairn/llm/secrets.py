"""Secret scans: fixed patterns, and windows of high Shannon entropy in strings of one alphabet.

A candidate is a longest run of an alphabet's characters, at least a window long. A
window slides over it one character at a time; the counts of its characters are
changed for the one that comes and the one that goes, and with them the sum of
c * log2(c), which gives the entropy. Windows of enough entropy that hold what the
alphabet asks for and touch no allowed stretch (a UUID, a checksum of a package,
a placeholder) are joined to spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase, digits

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow, slices

#: The patterns of the base kinds, and how many characters (of the group named) make a secret.
BASE = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
#: The same as hex, told by a search that passes over short runs quickly.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


@dataclass(frozen=True)
class Alphabet:
    """Strings of ``chars``: a window of so many characters counts from ``bits`` of entropy a character on, if it holds ``least`` of each part."""

    kind: str
    chars: str
    window: int
    bits: float
    parts: tuple[tuple[str, int], ...]

    def __post_init__(self):
        object.__setattr__(self, "runs", re.compile(f"(?<![{re.escape(self.chars)}])[{re.escape(self.chars)}]{{{self.window},}}"))

    def hot(self, text: str, banned: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
        """Spans of ``text`` (a candidate) that its windows of high entropy cover; windows that touch a banned stretch don't count."""
        width, out = self.window, []
        most = round(width * (math.log2(width) - self.bits) * UNIT)
        weigh = [round(c * math.log2(c) * UNIT) if c else 0 for c in range(width + 1)]
        counts: Counter[str] = Counter()
        part_of = {c: k for k, (chars, _) in enumerate(self.parts) for c in chars}
        held, least = [0] * len(self.parts), [n for _, n in self.parts]
        total, free_from, ahead = 0, 0, 0
        for stop, c in enumerate(text, 1):
            n = counts[c]
            total += weigh[n + 1] - weigh[n] if n < width else 0
            counts[c] = n + 1
            if c in part_of:
                held[part_of[c]] += 1
            if stop > width:
                gone = text[stop - width - 1]
                n = counts[gone]
                total += weigh[n - 1] - (weigh[n] if n <= width else weigh[width])
                counts[gone] = n - 1
                if gone in part_of:
                    held[part_of[gone]] -= 1
            while ahead < len(banned) and banned[ahead][0] < stop:
                free_from = max(free_from, banned[ahead][1])
                ahead += 1
            start = stop - width
            if start >= free_from and total <= most and all(h >= n for h, n in zip(held, least, strict=True)):
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], stop)
                else:
                    out.append((start, stop))
        return out


#: Sums of c * log2(c) are kept as integers of this unit, so that they don't drift.
UNIT = 1 << 20
#: Alphabets of the added kinds. Random strings of these alphabets have about 3.6, 4.0 and 4.2 bits in a window.
ALPHABETS = (
    Alphabet("entropy_hex", digits + "abcdefABCDEF", 32, 3.0, ((digits, 4), ("abcdefABCDEF", 4))),
    Alphabet("entropy_base36", digits + ascii_lowercase, 24, 3.5, ((digits, 4), (ascii_lowercase, 4))),
    Alphabet("entropy_base64", digits + ascii_lowercase + ascii_uppercase + "+/_-", 24, 3.9, ((digits, 1), (ascii_lowercase, 1), (ascii_uppercase, 1))),
)
#: What is no secret however it looks: UUIDs, checksums of packages, placeholders, alphabets in order.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"\bsha(?:1|256|384|512)[-:][A-Za-z0-9+/=]+",
    r"(?i:example|placeholder|changeme|dummy|your[_-])",
    r"(?i:abcdefgh|qwertyui|01234567|12345678|98765432)",
    r"([A-Za-z0-9*.])\1{5,}",
)
#: Characters on either side of a candidate that an allowed stretch may begin or end in.
AROUND = 48


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of what the base patterns find, each kind by itself."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        out += [(*m.span(), kind) for m in (LONG_HEX if kind == "hex" else pattern).finditer(text) if len(m[group]) >= least]
    return out


def secret_spans(text: str, alphabets: Sequence[Alphabet] = ALPHABETS, allowed: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """Base spans, and the spans of high entropy that lie in none of them and in none of an alphabet before; by start, then kind as listed."""
    found = base_spans(text)
    order = {kind: k for k, kind in enumerate([*BASE, *(a.kind for a in alphabets)])}
    for alphabet in alphabets:
        fresh = []
        for m in alphabet.runs.finditer(text):
            start, stop = m.span()
            low = max(0, start - AROUND)
            banned = [(a.start() + low - start, a.end() + low - start) for a in allowed.finditer(text, low, stop + AROUND)] if allowed else []
            fresh += [(start + a, start + b, alphabet.kind) for a, b in alphabet.hot(m[0], banned)]
        found += outside(fresh, found)
    return sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))


def outside(fresh: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Those that lie in none of ``found``."""
    if not fresh or not found:
        return fresh
    out, known, k, reach = [], sorted(found), 0, 0
    for start, stop, kind in fresh:
        while k < len(known) and known[k][0] <= start:
            reach = max(reach, known[k][1])
            k += 1
        if stop > reach:
            out.append((start, stop, kind))
    return out


def scan(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets", alphabets: Sequence[Alphabet] = ALPHABETS, allowed: Sequence[str] = ALLOWED, redacted_col: str | None = None) -> DataFrame:
    """Add ``spans_col``: kind, start and end (in code points, end exclusive) of every secret in the whole text, which is left out.

    Base kinds are found by patterns, leftmost and without overlap within a kind, and
    always reported. Kinds of ``alphabets`` are added where windows of high entropy
    lie outside what is known already; ``allowed`` patterns suppress those alone.
    With ``redacted_col``, the text with each span (overlapping ones as one)
    replaced by its first kind in angle brackets is added. A null or empty text
    has no spans and is redacted to an empty text. Rows are independent: repeated rows are scanned alike, an empty
    table gives an empty one; other columns pass unchanged, and columns named as
    those added are replaced.
    """
    added = [T.StructField(spans_col, T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    added += [T.StructField(redacted_col, T.StringType())] if redacted_col else []
    keep = [c for c in docs.columns if c not in {text_col, *(f.name for f in added)}]
    shaped = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *keep)
    schema = T.StructType([*shaped.schema.fields[1:], *added])
    patterns = "|".join(f"(?:{p})" if "\\1" not in p else p for p in sorted(allowed, key=lambda p: "\\1" not in p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ok = re.compile(patterns) if patterns else None
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for big in batches:
            for part in slices(big):
                texts = part.column(0).to_pylist()
                found = [secret_spans(x, alphabets, ok) for x in texts]
                columns = [*part.columns[1:], pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found], kind)]
                if redacted_col:
                    columns.append(pa.array(list(map(redacted, texts, found)), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return in_arrow(shaped, run, schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, stop, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
