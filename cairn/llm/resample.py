"""Importance resampling towards a target: weights from arrays, ranks by a distributed radix sort.

Features are runs of words, hashed to buckets. Both sides' counts give each bucket a
gain, and a document weighs the sum of its features' gains: its words become an array
of buckets, looked up in the array of gains. Gumbel noise from doc_id makes taking the
highest scores a draw without replacement.

The ranks come from a least-significant-digit radix sort. Rows lie in blocks of
consecutive places. A pass counts each digit in each block, the running sums of these
counts over digits and blocks say where a block's rows of a digit go, and rows
keep their order within these: a stable counting sort. Each pass is written.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import documents, forget, in_arrow, slices, stored, unused

#: Buckets of features, longest run of words, fewest words of a document that may be drawn, drawn share in percent, seed.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bits of a digit: a pass has at most 2**DIGIT_BITS counts a block, and as many offsets pass the driver.
DIGIT_BITS = 11
#: Rows of a block, at most; blocks are as many as shuffle partitions at least.
BLOCK_ROWS = 1 << 20
#: A-Z to a-z; what is neither letter, digit nor beyond ASCII to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Shift:
    """CRC-32 of strings put together: what the CRC of the first becomes when so many bytes follow."""

    def __init__(self):
        self.known: dict[int, np.ndarray] = {}

    @staticmethod
    def _apply(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros_like(vectors)
        for b in range(32):
            out ^= np.where((vectors >> np.uint32(b)) & np.uint32(1), matrix[b], np.uint32(0))
        return out

    def table(self, length: int) -> np.ndarray:
        """For each of the four bytes of a CRC, what its 256 values become."""
        if length not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
            square = np.where(bits & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0)) ^ (bits >> np.uint32(1))  # one bit that follows
            out, n = bits, 8 * length
            while n:
                out = self._apply(square, out) if n & 1 else out
                square = self._apply(square, square)
                n >>= 1
            self.known[length] = np.stack([self._apply(out, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])
        return self.known[length]

    def joined(self, first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRCs of pairs of strings, from the CRCs of both and the second's length in bytes."""
        kinds, kind = np.unique(lengths, return_inverse=True)
        tables = np.stack([self.table(int(n)) for n in kinds])
        out = second.copy()
        for b in range(4):
            out ^= tables[kind, b, (first >> np.uint32(8 * b)) & np.uint32(255)]
        return out


class Features:
    """Buckets of the runs of 1 to ``longest`` words of texts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST):
        self.buckets, self.longest, self.shift = buckets, longest, Shift()

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bucket of every feature, the text (by number) that has it, and how many words each text has."""
        number: dict[bytes, int] = defaultdict(count().__next__)
        listed = [[number[w] for w in x.encode().translate(FOLD).split()] for x in texts]
        sizes = np.array([len(x) for x in listed], np.int64)
        words = np.fromiter((w for x in listed for w in x), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not len(words):
            return words, owner, sizes
        # The words that follow are joined with the blank before them.
        alone = np.array([zlib.crc32(w) for w in number], np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in number], np.uint32)
        length = np.array([len(w) + 1 for w in number], np.int64)
        crc = alone[words]
        found, owners = [crc % np.uint32(self.buckets)], [owner]
        for more in range(1, self.longest):
            if len(words) <= more:
                break
            second = words[more:]
            crc = self.shift.joined(crc[: len(second)], after[second], length[second])
            inside = owner[more:] == owner[: len(second)]
            found.append(crc[inside] % np.uint32(self.buckets))
            owners.append(owner[more:][inside])
        return np.concatenate(found).astype(np.int64), np.concatenate(owners), sizes


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket, summed by task before the shuffle; ``buckets`` rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(buckets, longest), np.zeros(buckets, np.int64)
        for big in batches:
            for part in slices(big, 1024):
                total += np.bincount(features.of(part.column(0).to_pylist())[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = in_arrow(texts.select(F.coalesce(text_col, F.lit("")).alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r.bucket for r in rows]] = [r.n for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, with one more count everywhere."""
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((tb + 1) * (s + buckets) / ((sb + 1) * (t + buckets)))) for sb, tb in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """Add n_words, n_features and weight (long): the sum of the gains of a text's features; the text is left out.

    A null or empty text has none and weighs 0. Rows are independent; columns with
    these names are replaced, others pass unchanged.
    """
    keep = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight")]
    shaped = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *keep)
    schema = T.StructType([*shaped.schema.fields[1:], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain), longest)
        for big in batches:
            for part in slices(big, 1024):
                bucket, owner, sizes = features.of(part.column(0).to_pylist())
                weight = np.bincount(owner, gain[bucket], len(sizes)).astype(np.int64)  # sums far below 2**53 are exact
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(x, pa.int64()) for x in (sizes, np.bincount(owner, minlength=len(sizes)), weight))], names=schema.names)

    return in_arrow(shaped, run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a digest of seed and id; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def radix_ranks(rows: DataFrame, keys: list[tuple[str, bool]], rank_col: str = "rank", first: int | None = None) -> DataFrame:
    """Number rows 1, 2, 3, ... by long columns without nulls (name, and whether the largest comes first); rows with equal keys in some order.

    With ``first``, only so many rows are returned: a count by the leading
    bits of the first key tells which rows can't be among them, and these aren't
    sorted. A column named like ``rank_col`` is replaced. An empty table stays empty.
    """
    spark, rows = rows.sparkSession, rows.drop(rank_col)
    bounds = rows.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{f.__name__}{k}") for k, (c, _) in enumerate(keys) for f in (F.min, F.max))).first()
    total = wanted = bounds["n"]
    if not total or first == 0:
        return rows.withColumn(rank_col, F.lit(1).cast("long")).limit(0)
    place, block, digit, base, key = (unused(rows, f"_{x}") for x in ("place", "block", "digit", "base", "key"))
    from_least = [F.lit(bounds[f"max{k}"]) - F.col(c) if down else F.col(c) - F.lit(bounds[f"min{k}"]) for k, (c, down) in enumerate(keys)]
    bits = [int(bounds[f"max{k}"] - bounds[f"min{k}"]).bit_length() for k in range(len(keys))]
    kept = rows
    if first is not None and first < total:
        wanted, shift = first, max(0, bits[0] - 16)
        counts = sorted(rows.groupBy(F.shiftright(from_least[0], shift).alias(digit)).count().collect())  # 65,536 rows at most
        sums = np.cumsum([r["count"] for r in counts])
        last = int(np.searchsorted(sums, first))
        kept, total = rows.where(F.shiftright(from_least[0], shift) <= counts[last][0]), int(sums[last])
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_ROWS))
    per_block = max(1, -(-total // blocks))
    names = rows.columns
    # At first, rows lie in blocks by a hash of a number of their own, so that equal rows are spread, too.
    numbered = kept.select(*names, F.monotonically_increasing_id().alias(place))
    current = stored(numbered.select(*names, F.pmod(F.xxhash64(place), F.lit(blocks)).alias(block), place), "radix")
    bits[-1] = max(1, bits[-1])
    for k in reversed(range(len(keys))):
        for shift in range(0, bits[k], DIGIT_BITS):
            marked = current.withColumn(digit, F.shiftright(from_least[k], shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int"))
            counted = stored(marked.groupBy(block, digit).count(), "counts")
            digits = sorted((r[0], r[1]) for r in counted.groupBy(digit).agg(F.sum("count")).collect())  # 2**DIGIT_BITS rows at most
            begins = np.concatenate([[0], np.cumsum([n for _, n in digits])[:-1]]).tolist()
            offsets = F.broadcast(spark.createDataFrame([(d, int(b)) for (d, _), b in zip(digits, begins, strict=True)], f"{digit} int, {key} long"))
            blocks_before = Window.partitionBy(digit).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
            starts = counted.withColumn(base, F.coalesce(F.sum("count").over(blocks_before), F.lit(0))).join(offsets, digit).select(block, digit, (F.col(base) + F.col(key)).alias(base))
            ranked = marked.withColumn(key, F.row_number().over(Window.partitionBy(block, digit).orderBy(place)))
            moved = ranked.join(starts, [block, digit]).select(*names, (F.col(base) + F.col(key) - 1).alias(place))
            after = stored(moved.select(*names, F.expr(f"{place} div {per_block}").alias(block), place), "radix")
            forget(current, counted)
            current = after
    return current.where(F.col(place) < wanted).select(*names, (F.col(place) + 1).alias(rank_col))


def resample(docs: DataFrame, target: DataFrame, text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document: those with a rank are the draw, floor(percent * N / 100) of the N that may be drawn.

    Documents with ``least_words`` words or more may be drawn; the highest scores are, ties to the smaller doc_id. ``target``
    has texts in a column of the same name; those of both sides are counted whole. A null or empty text has no features, weighs 0
    and isn't drawn. A row without doc_id has no noise, so neither score nor rank, and isn't one of the N. Rows
    that repeat a doc_id are documents of their own, in some order where their scores are equal too. Without target texts the gains
    tell common features from rare ones; an empty table stays empty. Other columns, whatever their names, are left out. A task holds about 150 bytes for each word of a text.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, text_col))
    weighed = weigh(docs.select("doc_id", F.col(text_col).alias("text")), gain)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    may = scored.where((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    n_drawn = percent * may.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = radix_ranks(may.select(*columns), [("score", True), ("doc_id", False)], "rank", n_drawn)
    no_rank = F.lit(None).cast("long").alias("rank")
    if not n_drawn:
        return scored.select(*columns, no_rank)
    # The rest is told by the last one's score and id; only rows that repeat both need ranks of their own there.
    last = drawn.where(F.col("rank") == n_drawn).first()
    here = (F.col("score") == last["score"]) & (F.col("doc_id") == last["doc_id"])
    ahead = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.col("doc_id") <= last["doc_id"])))
    rest = scored.where(~F.coalesce(ahead, F.lit(False))).select(*columns, no_rank)
    found = drawn.unionByName(rest)
    taken, there = drawn.where(here).count(), may.where(here).count()
    if taken == there:
        return found
    same = radix_ranks(may.where(here).select(*columns), [("n_features", False), ("weight", False)])
    return found.where(~(here & F.col("rank").isNotNull())).unionByName(same.withColumn("rank", F.when(F.col("rank") <= taken, F.col("rank") + (n_drawn - taken))))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, weight, score and rank of every document, drawn towards the texts of the benchmark."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
