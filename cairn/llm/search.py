"""Exact BM25 top-k: an inverted index for each shard, searched by block-max WAND, merged under global statistics.

A shard is a run of rows that one task has read: its documents are indexed where
they lie, and only the index is written. Document frequencies are summed from the
indexes. Tasks then take one shard after another and stream the queries, from the
shared folder, past it, many at a time; what a query has found is its bar in the shards after.
"""

from __future__ import annotations

import functools
import hashlib
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, file_system, in_arrow, slices, stored

#: Parameters of BM25 and results of a query.
K1, B, TOP = 1.2, 0.75, 10
#: A shard ends with the document that takes it to so many documents or postings; a block is a run of documents whose largest impacts are known.
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 16384, 3 << 20, 64
#: Shards of at most so many postings together are held at once, so that a query's bar is carried from one to the next.
GROUP_POSTINGS = 1 << 22
#: Queries that are searched at once, and blocks in one product.
QUERIES, TILE = 128, 16
#: Long lists, kept as a matrix as well: those with a document in so many or more, but no more lists than this (the longest).
#: A product over a row of it costs as much as so many postings of short lists would if divided by the row's length and the queries.
DENSE_SHARE, DENSE_LISTS, WORTH = 32, 1024, 400
#: A bar is far above the long lists if it is so many times what they can give; then short lists are put off that together with these give
#: at most this share of the bar, until more documents than this come up to it without them.
FAR, PUT_OFF, MANY = 3, 0.8, 40
#: Bits of the filter of query terms (4 MB, whatever the input): terms that no query has needn't be indexed.
FILTER_BITS = 1 << 25
#: The base of terms' polynomials, and the mixing steps of splitmix64.
POWER, MIX = 0x9FB21C651E98DF25, ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
WORD = re.compile(r"\w+")
#: Bounds are taken a hair higher, as sums in another order may differ in their last digits.
HAIR = 1 + 1e-9
#: More than single precision errs by where up to DENSE_LISTS numbers, none below 0, are added; less than any score.
NEAR, TINY = 1 + 2e-4, 1e-30

INDEX = "ids array<long>, lengths array<int>, terms array<long>, sizes array<int>, places binary, counts binary"


@functools.cache
def word_characters() -> np.ndarray:
    """Which code points WORD takes."""
    found = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    found[ord("_")] = True
    return found


class TermCounter:
    """Texts as sorted 64-bit term hashes with counts. Terms are runs of letters, digits and _, in lower case.

    A term's hash is a polynomial of its characters, mixed; all terms of a text are hashed at once.
    """

    def __init__(self):
        self.in_word = word_characters()
        self.powers = np.full(1, POWER, np.uint64)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        letters = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.zeros(len(letters) + 2, bool)
        inside[1:-1] = self.in_word[letters]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        n = edges[1::2] - edges[::2]
        if not len(n):
            return np.zeros(0, np.int64), np.zeros(0, np.int32), 0
        if n.max() > len(self.powers):
            self.powers = np.cumprod(np.full(2 * n.max(), POWER, np.uint64))
        starts = np.cumsum(n) - n
        place = np.arange(starts[-1] + n[-1]) - np.repeat(starts, n)
        terms = np.add.reduceat((letters[inside[1:-1]] + np.uint64(1)) * self.powers[place], starts)
        for shift, factor in MIX:
            terms = (terms ^ (terms >> np.uint64(shift))) * np.uint64(factor)
        terms = np.sort((terms ^ (terms >> np.uint64(31))).view(np.int64))
        first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        return terms[first], np.diff(np.append(first, len(terms))).astype(np.int32), len(terms)


def place(terms: np.ndarray) -> np.ndarray:
    return (terms.view(np.uint64) % np.uint64(FILTER_BITS)).astype(np.int64)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, its distinct terms and a hash of all of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TermCounter()
        for big in batches:
            for part in slices(big):
                terms = [made.of(x)[0] for x in part.column(1).to_pylist()]
                texts = [hashlib.blake2b(t.tobytes(), digest_size=16).digest() for t in terms]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()), pa.array(terms, pa.list_(pa.int64()))], names=["query_id", "text", "terms"])

    return in_arrow(queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")), run, "query_id long, text binary, terms array<long>")


def filter_of(queries: DataFrame) -> np.ndarray:
    """The bitmap of the terms of all queries, of fixed size."""
    spread = F.expr(f"cast(pmod(term, {FILTER_BITS}) as int)")  # a power of two: the same for signed and unsigned
    words = queries.select(F.explode("terms").alias("term")).select(spread.alias("p")).selectExpr("p div 32 as w", "shiftleft(1L, p % 32) as b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().astype(np.uint32)
    return bits


def packed(held: list[tuple[int | None, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """A shard as a row of INDEX: postings by term, then by place.

    Documents are put next to others that use the same word most and are about as
    long, which makes the blocks' bounds tell more apart.
    """
    sizes = np.array([len(t) for _, _, t, _ in held])
    most = np.array([t[np.argmax(c)] if len(t) else 0 for _, _, t, c in held], np.int64)
    order = np.lexsort((sizes, most))
    terms, counts = np.concatenate([held[k][2] for k in order]), np.concatenate([held[k][3] for k in order])
    owners = np.repeat(np.arange(len(order), dtype=np.uint16), sizes[order])
    by_term = np.argsort(terms, kind="stable")
    terms = terms[by_term]
    starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, int)
    found, n = terms[starts], np.diff(np.append(starts, len(terms)))
    columns = [
        pa.array([[held[k][0] for k in order]], pa.list_(pa.int64())), pa.array([[held[k][1] for k in order]], pa.list_(pa.int32())), pa.array([found], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
        pa.array([owners[by_term].astype("<u2").tobytes()]), pa.array([counts[by_term].astype("<i4").tobytes()]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "terms", "sizes", "places", "counts"])


def index_of(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """A row of INDEX for each shard; only terms that pass the filter are in it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, bits = TermCounter(), shared.value
        held, postings = [], 0
        for big in batches:
            for part in slices(big):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t, c, n = made.of(text)
                    if len(t):
                        p = place(t)
                        keep = (bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
                        t, c = t[keep], c[keep]
                    held.append((doc, n, t, c))
                    postings += len(t)
                    if len(held) == SHARD_DOCS or postings >= SHARD_POSTINGS:
                        yield packed(held)
                        held, postings = [], 0
        if held:
            yield packed(held)

    return in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, INDEX)


def frequencies(index: DataFrame) -> DataFrame:
    """term and df, the number of documents that have it: shards' counts, added up by runs of terms, whole arrays at a time."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for terms, sizes in zip(*big.columns, strict=True):
                t, n = terms.values.to_numpy(), sizes.values.to_numpy()
                run = (t >> 56).astype(np.int32)  # ascending, as terms are
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(t)]]).astype(np.int32) if len(t) else np.zeros(1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(run[cuts[:-1]]), pa.ListArray.from_arrays(cuts, pa.array(t)), pa.ListArray.from_arrays(cuts, pa.array(n))], names=["run", "terms", "sizes"])

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        terms, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return terms, np.bincount(at, np.concatenate([x[1] for x in held])).astype(np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for big in batches:
            for run, terms, sizes in zip(big.column(0).to_pylist(), big.column(1), big.column(2), strict=True):
                if run != of and held:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], names=["term", "df"])
                    held = []
                of = run
                held.append((terms.values.to_numpy(), sizes.values.to_numpy()))
                if len(held) == 64:
                    held = [added(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in added(held)], names=["term", "df"])

    parts = in_arrow(index.select("terms", "sizes"), runs, "run int, terms array<long>, sizes array<int>").repartition("run").sortWithinPartitions("run")
    return in_arrow(parts, sums, "term long, df long")


def ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each of ``low`` up to ``high``, one run after another, and the runs' lengths."""
    n = high - low
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(low - ends + n, n), n


class Best:
    """The best documents of a query so far, better ones first, ties by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.missing = k, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def bar(self) -> float:
        """What a document must score to matter."""
        return self.scores[-1] if len(self.scores) == self.k else 0.0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            keep = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids, missing = scores[keep], ids[keep], missing[keep]
        scores, ids, missing = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.missing, missing])
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


class Bests:
    """The best documents of some queries, packed, as a task keeps them from one group of shards to the next."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids, self.missing = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def each(self) -> list[Best]:
        out = [Best(self.scores.shape[1]) for _ in self.scores]
        for i, (best, n) in enumerate(zip(out, np.count_nonzero(self.scores, 1), strict=True)):
            best.scores, best.ids, best.missing = self.scores[i, :n], self.ids[i, :n], self.missing[i, :n]
        return out

    def keep(self, bests: list[Best]) -> None:
        for i, best in enumerate(bests):
            n = len(best.scores)
            self.scores[i, :n], self.ids[i, :n], self.missing[i, :n] = best.scores, best.ids, best.missing


class Index:
    """A shard's postings with impacts, by term and by document; lists that many documents are in also as a dense matrix.

    Of ``blocks_met`` blocks ``blocks_scored`` were not skipped, and of ``entries_met`` entries of lists (an entry is a block
    of a list) at most ``entries_read`` were looked at.
    """

    def __init__(self, row: dict, mean: float):
        self.ids = row["ids"].fill_null(0).to_numpy(zero_copy_only=False)
        self.missing = row["ids"].is_null().to_numpy(zero_copy_only=False)
        lengths, sizes = row["lengths"].to_numpy(zero_copy_only=False), row["sizes"].to_numpy(zero_copy_only=False)
        self.terms = row["terms"].to_numpy(zero_copy_only=False)
        self.docs = np.frombuffer(row["places"], "<u2")
        self.counts = np.frombuffer(row["counts"], "<i4")
        self.damp = K1 * (1 - B + B * lengths / mean)
        n, self.n_blocks = len(self.ids), -(-len(self.ids) // BLOCK)
        impacts, owner, block = self.impacts, np.repeat(np.arange(len(self.terms), dtype=np.int32), sizes), self.docs // BLOCK
        cut = np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])]) if len(owner) else np.zeros(0, bool)
        #: The first posting of each entry, and the first entry and first posting of each list; a list's largest impact.
        self.starts = np.append(np.flatnonzero(cut), len(owner)).astype(np.int32)
        del block, cut
        self.lists = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.first = np.searchsorted(self.starts, self.lists)
        self.most = np.maximum.reduceat(impacts, self.lists[:-1]) if len(owner) else np.zeros(0)
        # Postings by document, in the order of terms.
        order = np.argsort(self.docs, kind="stable")
        self.of_term, self.of_impact = owner[order], impacts[order]
        self.rows = np.concatenate([[0], np.cumsum(np.bincount(self.docs, minlength=n))])
        # Documents of equal terms and lengths score alike: how many of them, by id, go before each.
        sums = np.zeros(len(order) + 1, np.uint64)
        np.take(self.terms.view(np.uint64), self.of_term, out=sums[1:])
        sums[1:] *= self.counts[order].astype(np.uint64)
        np.cumsum(sums, out=sums)
        alike = sums[self.rows[1:]] - sums[self.rows[:-1]]
        del owner, order, sums
        by = np.lexsort((self.ids, self.missing, lengths, alike))
        new = np.concatenate([[True], (alike[by][1:] != alike[by][:-1]) | (lengths[by][1:] != lengths[by][:-1])])
        self.copies = np.empty(n, np.int64)
        self.copies[by] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        #: Documents and single impacts side by side, so that a list is fetched once.
        pairs = np.empty((len(self.docs), 2), np.int32)
        pairs[:, 0], pairs.view(np.float32)[:, 1] = self.docs, impacts
        self.pairs = pairs.view(np.int64).ravel()
        # Long lists as a matrix, and the largest impacts of its blocks.
        long = np.flatnonzero(sizes.astype(np.int64) * DENSE_SHARE >= n)
        long = np.sort(long[np.argsort(-sizes[long], kind="stable")[:DENSE_LISTS]])
        self.slot = np.full(len(self.terms), -1, np.int32)
        self.slot[long] = np.arange(len(long))
        self.sizes = sizes[long].astype(np.int64)
        self.dense = np.zeros((len(long), self.n_blocks * BLOCK), np.float32)
        for row_of, low, high in zip(self.dense, self.lists[long], self.lists[long + 1], strict=True):
            row_of[self.docs[low:high]] = impacts[low:high]
        self.peaks = self.dense.reshape(len(long), self.n_blocks, BLOCK).max(2)
        self.weights = np.zeros(len(self.terms))
        self.blocks_met = self.blocks_scored = self.entries_met = self.entries_read = 0

    @property
    def impacts(self) -> np.ndarray:
        """What each posting gives for a weight of 1."""
        return self.counts * (K1 + 1) / (self.counts + self.damp[self.docs])

    def top(self, terms: np.ndarray, idf: np.ndarray, best: Best) -> None:
        """Put into ``best`` whatever of this shard belongs there."""
        self.tops(terms, idf, np.array([0, len(terms)]), [best])

    def tops(self, terms: np.ndarray, idf: np.ndarray, ends: np.ndarray, bests: list[Best]) -> None:
        """Block-max WAND for some queries at once; query i has the terms from ends[i] to ends[i + 1].

        A query whose lists' largest impacts don't add up to its bar reads nothing here. Short lists are read, and what they
        give is added up by document; but where the bar is far above what the long lists can give, as for a text that has
        copies, the longest of the short lists wait. Long lists have entries in nearly every block, so none is read before
        the block of a pivot: a block where what has been read and the largest impacts of all other lists add up to the
        bar. There the long lists' largest impacts of this block take the place of those of the lists, and blocks that don't
        add up to the bar now are skipped. The others are scored, the long lists by one product for all these queries, in
        single precision; documents that come up to the bar, within the error of that, are scored again in full.
        """
        if not len(self.terms):
            return
        ordered = np.argsort(terms)  # ascending ones are found much faster
        at = np.empty(len(terms), np.intp)
        at[ordered] = np.searchsorted(self.terms, terms[ordered])
        np.minimum(at, len(self.terms) - 1, out=at)
        found = np.flatnonzero(self.terms[at] == terms)
        query = (np.searchsorted(ends, found, "right") - 1).astype(np.intp)
        mine, weight = at[found], idf[found]
        bars = np.array([best.bar() for best in bests])
        reach = np.bincount(query, weight * self.most[mine], len(bests)) * HAIR
        live = np.flatnonzero((reach > 0) & (reach >= bars))
        self.blocks_met += self.n_blocks * int(np.count_nonzero(reach))
        self.entries_met += int((self.first[mine + 1] - self.first[mine]).sum())
        if not len(live):
            return
        k, slot = bests[0].k, self.slot[mine]
        # Lists that these queries use so often that they are worth a row of the product.
        rows = np.flatnonzero(np.bincount(slot[slot >= 0], minlength=len(self.sizes)) * self.sizes * WORTH >= len(self.ids) * len(live))
        to_row = np.full(len(self.sizes) + 1, -1)
        to_row[rows] = np.arange(len(rows))
        row = to_row[slot]
        cuts = np.searchsorted(query, np.arange(len(bests) + 1))
        bars = bars[live]
        given = np.zeros((len(live), self.n_blocks * BLOCK), np.float32)  # what lists give to documents
        long = np.zeros((len(live), len(rows)), np.float32)
        rest = np.zeros(len(live))  # what lists not read so far can give
        unread = {}
        for i, q in enumerate(live):
            here = slice(cuts[q], cuts[q + 1])
            of, m, w = row[here] >= 0, mine[here], weight[here]
            long[i, row[here][of]] = w[of]
            rest[i] = w[of] @ self.most[m[of]]
            m, w = m[~of], w[~of]
            if bars[i] > FAR * rest[i] > 0:
                most = w * self.most[m]
                by = np.argsort(self.lists[m] - self.lists[m + 1], kind="stable")
                later = np.zeros(len(m), bool)
                later[by[: np.searchsorted(np.cumsum(most[by]), PUT_OFF * bars[i] - rest[i])]] = True
                unread[i] = m[later], w[later], float(most[later].sum())
                rest[i] += unread[i][2]
                m, w = m[~later], w[~later]
            self._give(given[i], m, w)
        gone = np.flatnonzero(self.copies >= k)
        if len(gone):
            given[:, gone] = -np.inf  # k documents that score alike go before
        short = given.reshape(len(live), self.n_blocks, BLOCK).max(2)
        unset, peaks = np.flatnonzero(bars == 0), self.peaks[rows]
        for i in unset:  # the block that promises most sets a first bar
            low = int(np.argmax(short[i] + long[i] @ peaks)) * BLOCK
            bars[i] = max(self._kth(given[i], k), self._kth(given[i, low : low + BLOCK] + long[i] @ self.dense[rows, low : low + BLOCK], k))
        needs = (np.maximum(bars, TINY) / NEAR).astype(np.float32)
        pivots = short + rest[:, None].astype(np.float32) >= needs[:, None]
        self.entries_read += int(pivots.sum(1) @ np.count_nonzero(long, 1))
        left = np.array([unread[i][2] if i in unread else 0 for i in range(len(live))], np.float32)
        looked = np.flatnonzero(pivots.any(0))
        chosen = np.zeros_like(pivots)
        chosen[:, looked] = pivots[:, looked] & (short[:, looked] + long @ peaks[:, looked] + left[:, None] >= needs[:, None])
        self.blocks_scored += int(chosen.sum())
        scored = np.diff(np.concatenate([[0], chosen.any(0), [0]]))
        for first, last in zip(np.flatnonzero(scored == 1), np.flatnonzero(scored == -1), strict=True):
            for low in range(first * BLOCK, last * BLOCK, TILE * BLOCK):
                high = min(low + TILE * BLOCK, last * BLOCK)
                given[:, low:high] += long @ self.dense[rows, low:high]
        for i in unset:
            bars[i] = max(bars[i], self._kth(given[i], k))
        needs = (np.maximum(bars, TINY) / NEAR).astype(np.float32)
        for i, (m, w, most) in unread.items():
            if np.count_nonzero(given[i] >= needs[i] - np.float32(most)) > MANY:
                self._give(given[i], m, w)
                left[i] = 0
        of, doc = np.nonzero(given >= np.maximum(needs - left, np.float32(TINY))[:, None])
        to = np.searchsorted(of, np.arange(len(live) + 1))
        for i in np.flatnonzero(np.diff(to)):
            q, docs = live[i], doc[to[i] : to[i + 1]]
            here = slice(cuts[q], cuts[q + 1])
            scores = self._scores(mine[here], weight[here], docs)
            hit = np.flatnonzero((scores >= bests[q].bar()) & (scores > 0))
            if len(hit):
                bests[q].add(scores[hit], self.ids[docs[hit]], self.missing[docs[hit]])

    def _give(self, given: np.ndarray, mine: np.ndarray, weight: np.ndarray) -> None:
        """Add what lists give to the documents in them."""
        if len(mine):
            postings, n = ragged(self.lists[mine], self.lists[mine + 1])
            pairs = self.pairs[postings].view(np.int32).reshape(-1, 2)
            given[: len(self.ids)] += np.bincount(pairs[:, 0], np.repeat(weight.astype(np.float32), n) * pairs.view(np.float32)[:, 1], len(self.ids))
            self.entries_read += int((self.first[mine + 1] - self.first[mine]).sum())

    def _kth(self, given: np.ndarray, k: int) -> float:
        """What the k-th best document has at least; 0 if there are fewer."""
        return max(0.0, float(np.partition(given, len(given) - k)[len(given) - k]) / NEAR) if len(given) >= k else 0.0

    def _scores(self, mine: np.ndarray, weight: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of documents. Terms are added in one order everywhere, so that equal texts score alike."""
        self.weights[mine] = weight
        postings, n = ragged(self.rows[docs], self.rows[docs + 1])
        scores = np.bincount(np.repeat(np.arange(len(docs)), n), self.weights[self.of_term[postings]] * self.of_impact[postings], len(docs))
        self.weights[mine] = 0
        return scores


def groups(batches: Iterator[pa.RecordBatch], mean: float) -> Iterator[list[Index]]:
    """Indexes that are held at once; whoever takes a list empties it before the next is made."""
    held, postings = [], 0
    for big in batches:
        for at in range(big.num_rows):
            row = {n: c[at].as_buffer() if n in ("places", "counts") else c[at].values for n, c in zip(big.schema.names, big.columns, strict=True)}
            n = row["counts"].size // 4
            if held and postings + n > GROUP_POSTINGS:
                yield held
                held, postings = [], 0
            held.append(Index(row, mean))
            postings += n
    if held:
        yield held


def parts_of(source: list[str], rows: int) -> Iterator[pa.RecordBatch]:
    """Texts' hashes, terms and weights, so many rows at a time, in the same order each time."""
    import pyarrow.parquet as pq

    held: list[pa.RecordBatch] = []
    for path in source:
        store, name = file_system(path)
        with store.open_input_file(name) as file:
            for part in pq.ParquetFile(file).iter_batches(rows, columns=["text", "terms", "idf"]):
                held.append(part)
                if sum(x.num_rows for x in held) >= rows:
                    both = pa.concat_batches(held)
                    yield both.slice(0, rows)
                    held = [both.slice(rows)]
    if sum(x.num_rows for x in held):
        yield pa.concat_batches(held)


def searched(batches: Iterator[pa.RecordBatch], source: list[str], mean: float, k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of a task's shards for each text. Texts stream past one group of shards after another, and take their bars along."""
    found: list[tuple[pa.Array, Bests]] = []
    for indexes in groups(batches, mean):
        for at, part in enumerate(parts_of(source, QUERIES)):
            if at == len(found):
                found.append((part.column(0), Bests(part.num_rows, k)))
            bests = found[at][1].each()
            ends = np.concatenate([[0], np.cumsum(part.column(1).value_lengths().to_numpy())])
            terms, idf = part.column(1).flatten().to_numpy(), part.column(2).flatten().to_numpy()
            for i in range(len(indexes)):
                indexes[i].tops(terms, idf, ends, bests)
            found[at][1].keep(bests)
        indexes.clear()
    for texts, bests in found:
        row, place = np.nonzero(bests.scores)
        ids = pa.array(bests.ids[row, place], pa.int64(), mask=bests.missing[row, place])
        yield pa.RecordBatch.from_arrays([texts.take(pa.array(row)), ids, pa.array(bests.scores[row, place])], names=["text", "doc_id", "score"])


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of every query: query_id, rank, doc_id, score.

    ``queries`` has query_id and text; each distinct term of a text counts once.
    Ties are broken by doc_id; equal texts score alike, a document that is its
    own query is found as any other. Null and empty texts are found by nothing
    and find nothing; queries without query_id are left out, documents without
    doc_id are found last among equals. Rows that repeat a doc_id are documents
    of their own; queries that repeat a query_id are, too, if their terms differ,
    each with ranks from 1. With fewer matches than k, all are returned. Other
    columns of either table, whatever their names, are left out; an empty table
    on either side gives an empty table.
    """
    asked = stored(query_terms(queries.where(F.col("query_id").isNotNull()).select("query_id", "text")).dropDuplicates(["query_id", "text"]), "queries")
    index = stored(index_of(docs.select("doc_id", "text"), filter_of(asked)), "index")
    # Sums over shards.
    n, total = index.agg(F.sum(F.size("ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n, mean = n or 0, (total or 0) / max(1, n or 0) or 1.0
    known = frequencies(index).select("term", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    # Each text is searched once, next to texts of its kind: they need the same blocks.
    weighted = asked.dropDuplicates(["text"]).select("text", F.explode("terms").alias("term")).join(known, "term")
    weighted = weighted.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"), F.min(F.struct("idf", "term")).alias("common"))
    weighted = stored(weighted.orderBy("common", F.size("t")).select("text", F.col("t.term").alias("terms"), F.col("t.idf").alias("idf")), "weighted")
    source = sorted(weighted.inputFiles())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return searched(batches, source, mean, k)

    found = in_arrow(index.select("ids", "lengths", "terms", "sizes", "places", "counts"), run, "text binary, doc_id long, score double")
    order = Window.partitionBy("text").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.select("query_id", "text").join(best, "text").select("query_id", "rank", "doc_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for the whole text of every document whose id is divisible by 100."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text"))
