"""Line deduplication by pairwise alignment.

Documents overlap where they share a block of enough words. Single lines say little
of that (headings and footers stand in documents that have nothing else in common,
and a passage that thousands hold has no rare line), so candidates come from the hashes of
seeds: the shortest runs of adjacent lines that reach so many words, from a line on or up to one. A
document is paired with the first holder (smallest doc_id) of each of its seeds, so
pairs grow with the lines and never with the square of a group.

A pair is aligned by patience: first over the lines that each of both has once, then,
as long as the later document has a run of enough words that is left and the earlier one holds,
over such runs at their first places, so that moved and repeated blocks are aligned
in a turn of their own. The aligned blocks of enough words, and nothing else, are deleted from the later document.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, documents, forget, in_arrow, salted_join, slices, stored, unused

#: Common blocks of fewer words stay: short lines repeat in documents that have nothing else in common.
BLOCK_WORDS = 25
#: Alignments of a pair over runs that are left, before each is aligned by itself.
TURNS = 8
#: A holder of more pairs than this is repeated so many times, and its pairs are dealt to these.
HOT_PAIRS, SALTS = 1000, 32
#: Such holders are broadcast up to so many (16 bytes each); beyond that, their names are shuffled.
HOT_HOLDERS = 500_000
#: Lists of lines to delete are broadcast up to so many bytes, at so many for a list besides its places; beyond that, texts are shuffled to them.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 64
#: doc_id of rows that have none: they come after all others.
LAST = (1 << 63) - 1

SEQUENCES = "doc long, version long, lines array<long>, words array<int>"


def lines_of(text: str) -> tuple[list[int], list[int]]:
    """Hash and number of words of each line that isn't blank; white space counts as one blank."""
    split = [parts for line in text.split("\n") if (parts := line.split())]
    return [int.from_bytes(hashlib.blake2b(" ".join(x).encode(), digest_size=8).digest(), "big", signed=True) for x in split], [len(x) for x in split]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence: patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def once(lines: list[int]) -> dict[int, int]:
    """The place of each line that occurs once."""
    places: dict[int, int] = {}
    for k, line in enumerate(lines):
        places[line] = -1 if line in places else k
    return {line: k for line, k in places.items() if k >= 0}


def aligned(theirs: list[int], lines: list[int], anchors: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Blocks (first line, and the one after the last) of ``lines`` that patience aligns with blocks of ``theirs``.

    Anchors are places of equal lines, here and there, in the order of here: by default the lines that each of both has once.
    """
    if anchors is None:
        there, here = once(theirs), once(lines)
        anchors = [(k, there[line]) for line, k in here.items() if line in there]
    out, stop = [], 0
    for i in increasing([t for _, t in anchors]):
        k, t = anchors[i]
        if k < stop:
            continue  # a line of the block before
        start, off = k, t - k
        while start > stop and start + off > 0 and lines[start - 1] == theirs[start + off - 1]:
            start -= 1
        stop = k + 1
        while stop < len(lines) and stop + off < len(theirs) and lines[stop] == theirs[stop + off]:
            stop += 1
        out.append((start, stop))
    return out


def blocks(theirs: list[int], lines: list[int], words: list[int], least: int) -> list[int]:
    """The lines in aligned blocks of ``least`` words or more, by one alignment after another until no run of so many words is left that both hold."""
    gone = bytearray(len(lines))

    def take(found: list[tuple[int, int]]) -> None:
        for a, b in found:
            if sum(words[a:b]) >= least:
                gone[a:b] = b"\x01" * (b - a)

    take(aligned(theirs, lines))
    held = runs_held(theirs, lines, words, least)
    turns = 0
    while held := [w for w in held if not all(gone[w[0] : w[1]])]:
        turns += 1
        # Texts in ever other orders aren't worth more turns: then each run is aligned by itself.
        take(aligned(theirs, lines, [(a, t) for a, _, t in held]) if turns <= TURNS else [x for a, _, t in held for x in aligned(theirs, lines, [(a, t)])])
    return [k for k, x in enumerate(gone) if x]


def runs_held(theirs: list[int], lines: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """The shortest runs of lines of ``least`` words that ``theirs`` has, too, in order, with their first place there."""
    known, places = dict(zip(lines, words, strict=True)), {}
    raw, start = array("q", theirs).tobytes(), 0
    for stop in [k for k, x in enumerate(theirs) if x not in known] + [len(theirs)]:
        for a, b in spans([known[x] for x in theirs[start:stop]], least):
            key = raw[8 * (start + a) : 8 * (start + b)]
            places[key] = min(places.get(key, len(theirs)), start + a)
        start = stop + 1
    raw = array("q", lines).tobytes()
    return sorted((a, b, places[key]) for a, b in spans(words, least) if (key := raw[8 * a : 8 * b]) in places)


def spans(words: list[int], block_words: int) -> set[tuple[int, int]]:
    """The shortest runs of lines that hold ``block_words`` words, from each line on and up to each line."""
    n, out = len(words), set()
    for step in (1, -1):
        near = far = total = 0
        order = words[::step]
        for near in range(n):
            while far < n and total < block_words:
                total += order[far]
                far += 1
            if total < block_words:
                break
            out.add((near, far) if step == 1 else (n - far, n - near))
            total -= order[near]
    return out


def sequences_of(docs: DataFrame) -> DataFrame:
    """A row for every document (doc, version, text): its lines that aren't blank, in order. Rows that repeat doc and text are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                found = [lines_of(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int32()))], names=["doc", "version", "lines", "words"])

    return in_arrow(docs, run, SEQUENCES).dropDuplicates(["doc", "version"])


def seeds_of(sequences: DataFrame, block_words: int) -> DataFrame:
    """A row for every seed of a document, with its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big, limit=1 << 18):
                rows = []
                for doc, version, lines, words in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = array("q", lines).tobytes()
                    rows += [(int.from_bytes(hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest(), "big", signed=True), doc, version, a, b) for a, b in spans(words, block_words)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["seed", "doc", "version", "start", "stop"])

    return in_arrow(sequences, run, "seed long, doc long, version long, start int, stop int")


def overlaps(seeds: DataFrame) -> DataFrame:
    """Pairs of a document and an earlier one that is the first holder of one of its seeds."""
    here = F.struct("doc", "version")
    first = seeds.groupBy("seed").agg(F.min(here).alias("first"), F.max(here).alias("last")).where(F.col("first") != F.col("last")).select("seed", "first")
    both = salted_join(seeds, first, "seed", ["doc", "version"], "inner").where(here != F.col("first"))
    return both.select("doc", "version", F.col("first.doc").alias("holder"), F.col("first.version").alias("holder_version")).distinct()


def with_lines(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs with the lines of both. A passage that many hold has one holder: its lines are repeated, and its pairs are dealt out by document."""
    key = ["holder", "holder_version"]
    hot = bounded(pairs.groupBy(*key).count().where(F.col("count") > HOT_PAIRS).select(*key, F.lit(True).alias("hot")), HOT_HOLDERS)
    dealt = pairs.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    theirs = sequences.select(F.col("doc").alias("holder"), F.col("version").alias("holder_version"), F.col("lines").alias("theirs")).join(hot, key, "left")
    theirs = theirs.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    return dealt.join(theirs, [*key, "salt"]).join(sequences, ["doc", "version"])


def dedup_blocks(docs: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS, lines_col: str = "n_lines", removed_col: str = "n_removed") -> DataFrame:
    """Delete from every text the blocks of lines that it shares with earlier documents.

    A block is a run of adjacent lines, blank ones aside, of ``block_words`` words
    or more, that an earlier document holds as such a run. Adds ``lines_col``
    (lines that aren't blank) and ``removed_col`` to the columns of ``docs``, whose
    text column holds what is left; columns with these names are replaced. Earlier means a
    smaller doc_id; a null doc_id comes last, and different texts of one doc_id
    are in the order of their hashes. Rows that repeat doc_id and text are one
    document and get the same result. A copy of an earlier document of at least
    ``block_words`` words is left with an empty text, wherever its lines were
    first seen. A null text stays null, an empty one empty; an empty table stays
    empty; other columns, whatever their names, pass unchanged.
    """
    base = docs.drop(lines_col, removed_col)
    doc, version, places = (unused(base, x) for x in ("_doc", "_version", "_places"))
    keyed = base.withColumn(doc, F.coalesce("doc_id", F.lit(LAST))).withColumn(version, F.xxhash64(F.coalesce(text_col, F.lit(""))))
    sequences = stored(sequences_of(keyed.select(F.col(doc).alias("doc"), F.col(version).alias("version"), F.coalesce(text_col, F.lit("")).alias("text"))), "sequences")
    seeds = stored(seeds_of(sequences, block_words), "seeds")
    pairs = stored(overlaps(seeds), "pairs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                found = [blocks(theirs, lines, words, block_words) for theirs, lines, words in zip(*(part.column(k).to_pylist() for k in range(2, 5)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=[doc, version, places])

    found = in_arrow(with_lines(pairs, sequences).select("doc", "version", "theirs", "lines", "words"), align, f"{doc} long, {version} long, {places} array<int>")
    cuts = stored(found.groupBy(doc, version).agg(F.array_distinct(F.flatten(F.collect_list(places))).alias(places)), "cuts")
    forget(sequences, seeds, pairs)
    # Texts needn't be shuffled to lists of places that are small together.
    size = cuts.agg(F.sum(ROW_BYTES + 4 * F.size(places))).first()[0] or 0
    joined = keyed.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, [doc, version], "left").drop(doc, version)
    kept = base.columns
    schema = T.StructType([*base.schema.fields, T.StructField(lines_col, T.LongType()), T.StructField(removed_col, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for part in slices(big):
                texts, lines, removed = [], [], []
                for text, gone in zip(part.column(text_col).to_pylist(), part.column(places).to_pylist(), strict=True):
                    split = (text or "").split("\n")
                    full = [k for k, x in enumerate(split) if x.split()]
                    lines.append(len(full))
                    removed.append(len(gone or ()))
                    if gone:
                        cut_at = {full[p] for p in gone}
                        text = "\n".join(x for k, x in enumerate(split) if k not in cut_at) if len(gone) < len(full) else ""
                    texts.append(text)
                columns = [pa.array(texts, pa.string()) if n == text_col else part.column(n) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=schema.names)

    return in_arrow(joined.select(*kept, places), cut, schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that earlier ones hold."""
    return dedup_blocks(documents(spark, sf_dir).select("doc_id", "text"))
