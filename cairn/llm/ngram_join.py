"""Jaccard self-join of documents on word n-grams, by blocked sparse products.

Texts with equal sets are one class. A class is compared only if enough of its
first shingles (in the order of their hashes) occur in another class, and two
classes are compared only if they share one of their first shingles in an order
that puts frequent shingles last: pairs below the threshold's size bounds never
meet. Compared classes go through products of the document by n-gram incidence,
block by block; overlap counts add up and pairs below the bound are dropped.

The place of a shingle in its set's order bounds what can follow it: sets that
first meet there share no more than what the shorter rest holds. So every entry of
a shingle's list knows the largest set that it could link to there, and entries
that no set of the list is small enough for are left out: copies that differ too
much from all others.

A group of near copies isn't compared pair by pair. First every class of a list
meets the list's pivot, the class that shares most; what that links is one
component. Then only classes that a list still has outside its pivot's component
are multiplied with the whole list, in blocks. Two classes that no product has
compared are in one component already, so no component is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, in_arrow, salted_join, slices, stored
from .components import components

#: Words of a shingle; link at |A & B| * 100 >= PERCENT * |A | B|.
SHINGLE, PERCENT = 5, 80
#: Classes of a block on either side of a product, and shingles of a block's rows. A block with more columns is done in parts.
ROWS, COLUMNS, ROW_SHINGLES = 64, 256, 1 << 17
#: Shingles that count as frequent are broadcast, at most so many (8 bytes each): the most frequent ones.
FREQUENT = 1_000_000
#: Bits of the filter that spares documents without candidates a shuffle (4 MB; more documents only make it let more through).
FILTER_BITS = 1 << 25
MEMORY_WORDS = 150_000


class Shingler:
    """Texts as sorted distinct 64-bit hashes of their shingles."""

    def __init__(self, n: int):
        self.n, self.known = n, {}
        self.factors = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, n + 1)], np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total + h[k : len(h) - n + 1 + k]) * self.factors[k]
            total ^= total >> np.uint64(29)
        return np.unique(total.view(np.int64))


def least_overlap(n, percent: int):
    """What a set of n shares at least with any that it links to."""
    return -(-percent * n // 100)


def class_of(shingles: np.ndarray) -> int | None:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else None


def extra(n: int) -> int:
    """How many shingles two linked sets must share among their first ones, for these to be looked at by class."""
    return max(1, n // 20)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and known: a row without doc_id gets a number by its text, so that links through its text count; known tells it from ids."""
    stand_in = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1) + F.lit(1 << 62)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select(F.coalesce("doc_id", stand_in).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("known"))


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, known, n, class and the first shingles in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(SHINGLE)
        for big in batches:
            for part in slices(big):
                sets = [made.of(x) for x in part.column(1).to_pylist()]
                classes = [class_of(s) for s in sets]
                seen: set = set()
                firsts = []
                for c, s in zip(classes, sets, strict=True):
                    n = len(s)
                    firsts.append(s[:0] if c in seen else s[: n - least_overlap(n, percent) + extra(n)])
                    seen.add(c)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
                first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), first], names=["doc_id", "known", "n", "cls", "first"])

    return in_arrow(numbered(docs), run, "doc_id long, known boolean, n long, cls long, first array<long>")


def filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed ids; of fixed size, so it may go to the driver and to every executor."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(place.alias("p")).selectExpr("cast(p div 32 as int) as w", "shiftleft(1L, cast(p % 32 as int)) as b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return bits


def full_sets(docs: DataFrame, chosen: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """cls, n, whole set and first shingles, frequent ones last, of the chosen documents (doc_id, cls, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((filter_of(chosen), np.sort(frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingler(SHINGLE)
        bits, often = shared.value
        for big in batches:
            for part in slices(big):
                where = part.column(1).to_numpy()
                part = part.filter(pa.array((bits[where >> 5] >> (where & 31).astype(np.uint32)) & 1 == 1))
                sets = [made.of(x) for x in part.column(2).to_pylist()]
                firsts = []
                for s in sets:
                    last = np.isin(s, often, assume_unique=True) if len(often) else np.zeros(len(s), bool)
                    firsts.append(np.concatenate([s[~last], s[last]])[: len(s) - least_overlap(len(s), percent) + 1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                    names=["doc_id", "cls", "n", "shingles", "first"],
                )

    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long")
    made = numbered(docs).select("doc_id", place.alias("place"), "text")
    made = in_arrow(made, run, "doc_id long, cls long, n long, shingles array<long>, first array<long>")
    # A class has one chosen document, so this keeps one row a class, where the join has put it.
    return made.join(chosen, ["doc_id", "cls"]).dropDuplicates(["doc_id", "cls"]).drop("doc_id")


class Block:
    """The rows of a product as an incidence matrix, which columns meet one at a time."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], percent: int):
        self.percent, self.classes = percent, [cls for cls, _ in rows]
        self.vocabulary = np.unique(np.concatenate([s for _, s in rows]))
        self.incidence = np.zeros((len(self.vocabulary), len(rows)), np.uint8)
        for k, (_, s) in enumerate(rows):
            self.incidence[np.searchsorted(self.vocabulary, s), k] = 1
        self.sizes = np.array([len(s) for _, s in rows])
        self.leader: dict[int, int] = {}

    def find(self, x: int) -> int:
        leader = self.leader
        while leader.setdefault(x, x) != x:
            leader[x] = leader[leader[x]]
            x = leader[x]
        return x

    def links(self, cls: int, s: np.ndarray) -> list[tuple[int, int]]:
        """Links of a column to rows, without those that follow from links before."""
        sizes, percent = self.sizes, self.percent
        # Size-derived bound: the smaller set must hold the least overlap of the larger.
        fits = 100 * np.minimum(sizes, len(s)) >= percent * np.maximum(sizes, len(s))
        if not fits.any():
            return []
        at = np.searchsorted(self.vocabulary, s)
        at = at[self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == s]
        overlap = self.incidence[at].sum(axis=0, dtype=np.int64)
        out = []
        for k in np.flatnonzero(fits & (100 * overlap >= percent * (sizes + len(s) - overlap))):
            a, b = self.find(self.classes[k]), self.find(cls)
            if a != b:
                self.leader[a] = b
                out.append((self.classes[k], cls))
        return out


def products(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b within blocks. members: block (long), side (0: rows, of which a block has ROWS or so; 1: columns), cls."""
    parts = members.where("side = 1").groupBy("block").agg(F.ceil(F.count("*") / COLUMNS).cast("int").alias("parts"))
    columns = members.where("side = 1").join(parts, "block").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    rows = members.where("side = 0").join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = rows.unionByName(columns).select("block", "part", "side", "cls").join(sets.select("cls", "shingles"), "cls")
    both = both.repartition("block", "part").sortWithinPartitions("block", "part", "side").select("block", "part", "side", "cls", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, block = None, [], None
        for big in batches:
            out: list[tuple[int, int]] = []
            at, n, sides, classes, lists = (big.column(k) for k in range(5))
            for number, part, side, cls, s in zip(at.to_pylist(), n.to_pylist(), sides.to_pylist(), classes.to_pylist(), lists, strict=True):
                if (number, part) != key:
                    key, rows, block = (number, part), [], None
                values = s.values.to_numpy(zero_copy_only=False)
                if side == 0:
                    rows.append((cls, values))
                elif rows:
                    block = block or Block(rows, percent)
                    out += block.links(cls, values)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return in_arrow(both, run, "a long, b long")


def linked_classes(docs: DataFrame, base: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node and root among the classes that link to others."""
    spark = docs.sparkSession
    entries = base.select(F.explode("first").alias("hash"), "cls", "n")
    shared = stored(entries.groupBy("hash").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count("*").alias("times")).where("low <> high").select("hash", "times"), "shared")
    met = entries.join(shared, "hash").groupBy("cls", "n").agg(F.count("*").alias("met"))
    candidates = met.where(F.col("met") >= F.greatest(F.lit(1), F.expr("n div 20")))
    chosen = stored(candidates.join(classes, "cls").select(F.col("rep").alias("doc_id"), "cls", (F.col("met") / F.col("n")).alias("score")), "chosen")
    # The frequent shingles: as low a bound as leaves FREQUENT of them. The order matters for speed alone.
    levels = sorted(((r.level, r.n) for r in shared.where("times >= 32").groupBy(F.floor(F.log2("times")).alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)  # 64 rows at most
    bound, held = None, 0
    for level, n in levels:
        held += n
        if held > FREQUENT:
            break
        bound = 2**level
    frequent = shared.where(F.col("times") >= bound).select("hash").toArrow().column("hash").to_numpy() if bound else np.zeros(0, np.int64)
    sets = stored(full_sets(docs, chosen, frequent, percent), "sets", "none")
    forget(shared, chosen)
    # No set of more than ``most`` shingles links through this one, if none before it is shared.
    most = F.expr(f"({100 + percent} * (n - place) - {percent} * n) div {percent}")
    places = sets.select(F.posexplode("first").alias("place", "hash"), "cls", "n", "score").withColumn("most", most)
    best = F.max(F.struct("score", "cls", "n", "most"))
    lists = places.groupBy("hash").agg(F.count("*").alias("m"), F.min("n").alias("smallest"), best.alias("best")).where("m > 1")
    lists = stored(lists.select("hash", "m", "smallest", F.col("best.cls").alias("pivot"), F.col("best.n").alias("pivot_n"), F.col("best.most").alias("pivot_most")), "lists")
    members = stored(places.select("hash", "cls", "n", "most").join(lists, "hash").where("most >= smallest").drop("smallest"), "members")
    # Every class meets the pivots of its lists, if their sizes let them link.
    met = members.where("cls <> pivot and pivot_n <= most and n <= pivot_most").where(100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")).select("pivot", "cls").distinct()
    pivots = stored(met.select(F.col("pivot").alias("block"), F.lit(1).alias("side"), "cls").unionByName(met.select(F.col("pivot").alias("block"), F.lit(0).alias("side"), F.col("pivot").alias("cls")).distinct()), "pivots")
    links = stored(products(pivots, sets, percent), "links")
    forget(lists, pivots)
    roots = components(links)
    # What a list has outside its pivot's component meets the whole list. Lists of two are done.
    label = roots.select(F.col("node").alias("cls"), F.col("root").alias("label"))
    pivot_label = roots.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_label"))
    labelled = members.where("m > 2").join(label, "cls", "left").join(pivot_label, "pivot", "left")
    labelled = stored(labelled.select("hash", "cls", "n", "most", "pivot", "m", (F.coalesce("label", "cls") != F.coalesce("pivot_label", "pivot")).alias("outside")), "labelled")
    forget(members)
    rows, met = meeting(labelled, percent)
    rest = stored(products(met, sets, percent), "links")
    forget(labelled, rows, met, sets)
    if rest.isEmpty():
        forget(links, rest)
        return roots
    found = components(links.unionByName(rest))
    forget(links, rest)
    return found


def meeting(labelled: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Blocks for ``products``: rows are the classes outside, columns the other members of their lists whose sizes may do. Also the rows alone.

    A pair of a block and a column may come from many lists, as near copies share
    most of their shingles. Where the lists of one pivot have that much in common,
    their members are put together first, and the block meets each of them once.
    """
    rows = labelled.where("outside")
    # A class's rows are in one block: that of its longest list's pivot and of its own size, split to ROWS or so.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    home = rows.groupBy("cls", "n").agg(F.max(F.struct("m", "pivot")).alias("home")).select("cls", "n", F.col("home.pivot").alias("home"), band.alias("band"))
    sizes = home.groupBy("home", "band").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(F.sum("n") / ROW_SHINGLES)).alias("blocks"))
    home = home.join(sizes, ["home", "band"]).select("cls", F.xxhash64("home", "band", F.pmod(F.xxhash64("cls"), F.col("blocks"))).alias("block"))
    rows = stored(rows.select("hash", "cls", "n", "most", "pivot", "m").join(home, "cls").select("hash", "cls", "n", "most", "pivot", "m", "block"), "rows")
    bounds = [F.min("n").alias("low"), F.max("n").alias("high"), F.max("most").alias("top")]
    by_list = rows.groupBy("hash", "pivot", "block").agg(*bounds, F.max("m").alias("m"))
    by_pivot = rows.groupBy("pivot", "block").agg(*bounds)
    own = labelled.where("cls <> pivot").select("hash", "pivot", "cls", "n", "most")
    together = own.groupBy("pivot", "cls", "n").agg(F.max("most").alias("most"))
    # What either way would make of a pivot's lists.
    apart = by_list.groupBy("pivot").agg(F.sum("m").alias("apart"))
    joint = by_pivot.groupBy("pivot").agg(F.count("*").alias("blocks")).join(together.groupBy("pivot").agg(F.count("*").alias("classes")), "pivot")
    joined = stored(joint.join(apart, "pivot").where(F.col("blocks") * F.col("classes") < F.col("apart")).select("pivot"), "joined")
    fits = (F.col("n") <= F.col("top")) & (F.col("most") >= F.col("low")) & (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    listed = by_list.join(joined, "pivot", "left_anti").drop("pivot").join(own.drop("pivot"), "hash").where(fits).select("block", "cls")
    grouped = by_pivot.join(joined, "pivot").join(together, "pivot").where(fits).select("block", "cls")
    columns = listed.unionByName(grouped).distinct().select("block", F.lit(1).alias("side"), "cls")
    met = stored(columns.unionByName(rows.select("block", F.lit(0).alias("side"), "cls").distinct()), "meeting")
    forget(joined)
    return rows, met


def jaccard_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row.

    Texts are lower-cased (A-Z) and split at ASCII white space; a set holds the
    distinct shingles of SHINGLE words, or the whole sequence if there are fewer.
    component_id is the smallest doc_id reachable by links at ``percent`` or
    more, itself included. Null and empty texts have no shingles and no links.
    Rows that repeat a doc_id are rows of their own, linked by their texts; a row
    without doc_id has none to give to its group, but its text links as any other does (a group of such rows alone has a null component_id).
    Other columns are left out. An empty table gives an empty table.
    """
    base = stored(sketches(docs, percent), "sketches", "none")
    classes = stored(base.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.coalesce(F.min(F.when(F.col("known"), F.col("doc_id"))), F.min("doc_id")).alias("rep"), F.min(F.when(F.col("known"), F.col("doc_id"))).alias("least"), F.count("*").alias("copies")), "classes")
    roots = linked_classes(docs, base, classes, percent)
    label = roots.select(F.col("node").alias("cls"), "root")
    labelled = classes.join(label, "cls", "left").select("cls", "copies", "least", F.coalesce("root", "cls").alias("root"), F.col("root").isNotNull().alias("linked"))
    heads = roots.select("root").distinct().withColumn("head", F.lit(True))
    labelled = labelled.join(heads, "root", "left")
    groups = labelled.where(F.col("linked") | F.col("head"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    found = groups.join(least, "root").select("cls", "component_id").unionByName(labelled.where(~F.col("linked") & F.col("head").isNull() & (F.col("copies") > 1)).select("cls", F.col("least").alias("component_id")))
    # Rows are salted by their place in the stored table, so that equal rows are spread, too.
    out = salted_join(base.select("doc_id", "known", "n", "cls", F.monotonically_increasing_id().alias("_row")), found, "cls", ["_row"])
    own = F.when(F.col("known"), F.col("doc_id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", own).alias("component_id"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of similar documents."""
    return jaccard_groups(documents(spark, sf_dir))
