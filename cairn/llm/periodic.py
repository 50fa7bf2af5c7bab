"""Runs of repeated words by internal pattern matching.

The texts of a batch are one sequence of word numbers, with a number of its own
after each text. Prefix doubling gives its suffix array and, for every power of
two, the interval of the array that a block of so many words has. A run of period
q holds an aligned block whose next copy stands q words on, so every aligned block
asks a wavelet matrix over the suffix array for its occurrences in windows of
starts after it, no longer than the block: they are an arithmetic progression,
given by the first, the second and their number. Each term is a candidate for the
period, and is extended to both sides by comparing classes of blocks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow, slices

#: The fewest words of a run; it holds its period twice at least.
LEAST_WORDS = 12
#: Bytes of texts that are one sequence (a longer text is one of its own).
SEQUENCE_BYTES = 1 << 20
#: Candidates that are extended at once.
CANDIDATES = 1 << 18


class Suffixes:
    """The suffix array of a sequence of numbers, and what is equal for 1, 2, 4, ... of them.

    ``ranks[k][i]`` is where the suffixes begin, in the array, that agree with
    suffix i in the first 2**k numbers. The last number must occur once.
    """

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        order = np.argsort(numbers, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = self._starts(numbers[order])
        self.ranks = [rank.astype(np.int32)]
        slots = np.arange(n)
        while True:
            # Places of the array whose suffix isn't told from its neighbours yet.
            ranked = rank[order[slots]]
            alone = np.ones(len(slots), bool)
            same = ranked[1:] == ranked[:-1]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            slots, ranked = slots[~alone], ranked[~alone]
            if not len(slots):
                break
            at = order[slots]
            ahead = at + (1 << (len(self.ranks) - 1))
            key = ranked * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            sort = np.argsort(key, kind="stable")
            order[slots] = at[sort]
            fresh = rank.copy()
            fresh[at[sort]] = slots[self._starts(key[sort])]
            rank = fresh
            self.ranks.append(rank.astype(np.int32))
        self.array = order

    @staticmethod
    def _starts(values: np.ndarray) -> np.ndarray:
        """For sorted values, where those equal to each begin."""
        first = np.ones(len(values), bool)
        first[1:] = values[1:] != values[:-1]
        return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))

    def level(self, k: int) -> np.ndarray:
        """Classes of blocks of 2**k; past the last level no two agree."""
        return self.ranks[min(k, len(self.ranks) - 1)]

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far to the left of places a < b, and from them on, numbers agree; longest blocks first."""
        n = len(self.array)
        left, right = np.zeros_like(a), np.zeros_like(a)
        for k in reversed(range(len(self.ranks))):
            step, rank = 1 << k, self.ranks[k]
            for _ in range(2 if k == len(self.ranks) - 1 else 1):
                x, y = np.minimum(a + right, n - 1), np.minimum(b + right, n - 1)
                right += step * (rank[x] == rank[y])
                x, y = a - left - step, b - left - step
                left += step * ((x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)]))
        return left, right


class Wavelet:
    """A wavelet matrix over numbers below 2**bits: counts and order statistics of any stretch, many at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            bit = (values >> b) & 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - bit, out=zeros[1:])
            self.zeros.append(zeros)
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of [lo, hi) are smaller than the bound."""
        out = np.where(bound >> self.bits > 0, hi - lo, 0)
        inside = bound >> self.bits == 0
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, h0 = zeros[lo], zeros[hi]
            one = ((bound >> b) & 1).astype(bool)
            out += np.where(one & inside, h0 - l0, 0)
            lo, hi = np.where(one, zeros[-1] + lo - l0, l0), np.where(one, zeros[-1] + hi - h0, h0)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) of [lo, hi)."""
        out = np.zeros(len(lo), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, h0 = zeros[lo], zeros[hi]
            one = k >= h0 - l0
            out |= one.astype(np.int64) << b
            k = np.where(one, k - (h0 - l0), k)
            lo, hi = np.where(one, zeros[-1] + lo - l0, l0), np.where(one, zeros[-1] + hi - h0, h0)
        return out


def windows(least_words: int, longest: int) -> Iterator[tuple[int, int, int, int]]:
    """Levels k, distances of block starts, and stretches (first, last) of periods to ask for.

    A run of period q and length l agrees with itself, q on, in l - q words, which
    are max(least_words - q, q) at least. They hold an aligned block of b words if
    they are 2 * b - 1 or more; blocks of step b / 2, if they are b + b / 2 - 1.
    """
    last = 0
    for k in count(2):
        block, first = 1 << k, last + 1
        if last >= longest:
            return
        step, last = block >> (k == 2), first  # periods of 6 words may leave 6 that agree, too few for aligned blocks of 4
        while max(least_words - last - 1, last + 1) < 4 * block - 1 or (k == 2 and last < 14):
            last += 1
        for low in range(first, last + 1, block + 1):
            yield k, step, low, min(low + block, last)


def runs_of(numbers: np.ndarray, longest: int, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of every run, by start, then period.

    A run has the smallest period q, a length of ``least_words`` and 2 * q at least,
    and no neighbour extends it. ``longest`` bounds the periods.
    """
    suffixes = Suffixes(numbers)
    n, wavelet, found = len(numbers), None, [np.zeros((0, 3), np.int64)]
    for k, step, low, high in windows(least_words, longest):
        if k >= len(suffixes.ranks):
            break  # no longer block occurs twice
        rank = suffixes.level(k)
        starts = np.arange(0, n, step)
        lo = rank[starts].astype(np.int64)
        sizes = np.bincount(rank, minlength=n)[lo]
        many = sizes > 1
        starts, lo, hi = starts[many], lo[many], (lo + sizes)[many]
        if not len(starts):
            continue
        wavelet = wavelet or Wavelet(suffixes.array)
        before = wavelet.below(lo, hi, starts + low)
        times = wavelet.below(lo, hi, starts + high + 1) - before
        hit = times > 0
        starts, lo, hi, before, times = starts[hit], lo[hit], hi[hit], before[hit], times[hit]
        if not len(starts):
            continue
        first = wavelet.smallest(lo, hi, before)
        gap = np.zeros_like(first)
        more = times > 1
        gap[more] = wavelet.smallest(lo[more], hi[more], before[more] + 1) - first[more]
        # Where block and occurrences lie in one stretch of period gap, a lower level or window has found it, and their distances are its multiples.
        far = first + times * gap + (1 << k) - 2 * gap - starts
        within = more.copy()
        within[more] = suffixes.extend(starts[more], starts[more] + gap[more])[1] >= far[more]
        rest = ~(within & (gap < low) & ((first - starts) % np.maximum(gap, 1) == 0))
        starts, first, gap, times = starts[rest], first[rest], gap[rest], times[rest]
        ends = np.cumsum(times)
        for a in range(0, len(starts), max(1, CANDIDATES // (high - low + 1))):
            part = slice(a, a + max(1, CANDIDATES // (high - low + 1)))
            nth = np.arange(times[part].sum()) - np.repeat(ends[part] - times[part] - (ends[a] - times[a]), times[part])
            at = np.repeat(starts[part], times[part])
            period = np.repeat(first[part], times[part]) + nth * np.repeat(gap[part], times[part]) - at
            left, right = suffixes.extend(at, at + period)
            length = left + right + period
            good = length >= np.maximum(least_words, 2 * period)
            found.append(np.unique(np.stack([at - left, length, period], 1)[good], axis=0))
    rows = np.unique(np.concatenate(found), axis=0)  # of a stretch, the smallest period comes first
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[fresh]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def runs_of_texts(texts: list[list[bytes]], least_words: int = LEAST_WORDS) -> list[np.ndarray]:
    """For each list of words its runs, as rows of start, length and period."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    listed = [[number[w] for w in words] for words in texts]
    sizes = np.array([len(x) for x in listed], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    sequence = np.empty(begins[-1], np.int64)
    for k, x in enumerate(listed):
        sequence[begins[k] : begins[k + 1] - 1] = x
        sequence[begins[k + 1] - 1] = len(number) + k
    if not len(sequence):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    start, length, period = runs_of(sequence, int(sizes.max()) // 2, least_words)
    cuts = np.searchsorted(start, begins)
    return [np.stack([start[a:b] - begins[k], length[a:b], period[a:b]], 1) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``runs_col`` (start, length and period in words, numbered from 0, by start, then period) and ``collapsed_col``, and leave out the text.

    Words are what stands between the white space of ASCII (0x20 and 0x09 to
    0x0D). A run is a stretch of words with smallest period q, of
    ``least_words`` words (12 or more; fewer give 12) and 2 * q at least, that no neighbouring word extends.
    The collapsed text has the words that no run holds after its first q words,
    joined by one space. A null or empty text has no runs and collapses to an
    empty one. Rows are independent: repeated rows are searched alike, an empty
    table gives an empty one; other columns pass unchanged, and columns named as
    those added are replaced. A task holds about 300 bytes for each word of a text.
    """
    least_words = max(LEAST_WORDS, least_words)
    keep = [c for c in docs.columns if c not in (text_col, runs_col, collapsed_col)]
    shaped = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *keep)
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([*shaped.schema.fields[1:], T.StructField(runs_col, T.ArrayType(run)), T.StructField(collapsed_col, T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big, 1024, SEQUENCE_BYTES):
                words = [x.encode().split() for x in part.column(0).to_pylist()]
                found = runs_of_texts(words, least_words)
                rows = np.concatenate(found)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                structs = pa.StructArray.from_arrays([pa.array(rows[:, c], pa.int64()) for c in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
                short = pa.array([x.decode() for x in map(collapsed, words, found)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, short], names=schema.names)

    return in_arrow(shaped, search, schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every document; in the documents that the contract names, the words from one on are repeated first."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words, g = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"), F.floor(h / 10)
    named = docs.where(h % 10 == 0).withColumn("w", words).withColumn("n", F.size("w")).where("n > 0").withColumn("a", F.pmod(g, F.col("n")).cast("int"))
    named = named.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    planted = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), "p")))), " ")
    named = named.select("doc_id", planted.alias("text"))
    others = docs.where(~F.coalesce(h % 10 == 0, F.lit(False)) | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    found = find_runs(others.unionByName(named))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", longest)
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
