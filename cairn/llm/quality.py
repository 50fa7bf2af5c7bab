"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, in_arrow, slices

#: At most so many labelled rows of each class are learned from: those with the smallest hashes of doc_id. This bounds
#: what the driver decomposes and what is broadcast (2 * 3000 vectors of 48 numbers, 1.2 MB).
PER_CLASS = 3000
#: Hashed terms, latent dimensions, neighbours that vote, and the power of the cosine that weights a vote.
TERMS, DIMENSIONS, NEIGHBOURS, POWER = 2048, 48, 25, 8
#: From this score on a document counts as good.
GOOD = 0.3
#: Documents of one matrix product.
BLOCK = 256
MEMORY_WORDS = 150_000


def place(term: str) -> int:
    return zlib.crc32(term.encode()) % TERMS


def shape(word: str) -> str:
    """Letter case, inner marks and the marks that end a word."""
    core = word.rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…")
    tail = word[len(core) :][:4]
    if not core:
        kind = "-"
    elif core.isdigit():
        kind = "9"
    elif core.isalpha():
        kind = "a" if core.islower() else "A" if core.isupper() and len(core) > 1 else "Aa" if core[1:].islower() or len(core) == 1 else "aA"
    else:
        kind = "x"
    return f"shape {kind} {tail}"


class Terms:
    """Texts as sparse vectors: hashed words, their shapes, and how much of the text repeats."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct places and log-scaled counts. An empty text has the one term that says so."""
        listed = text.split()
        counts = Counter(listed)
        if not counts:
            return np.array([place("empty")]), np.ones(1)
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        for w in [w for w in counts if w not in known]:
            known[w] = (place("word " + w.lower()), place(shape(w)))
        n = counts.total()
        times = np.fromiter(counts.values(), float, len(counts))
        places = np.array([known[w] for w in counts])
        words = np.bincount(places[:, 0], times, TERMS)
        shapes = np.bincount(places[:, 1], times, TERMS)
        lines = [x for x in text.split("\n") if x.strip()]
        extra = [f"distinct {round(10 * len(counts) / n)}", f"lines {round(5 * len(set(lines)) / max(1, len(lines)))}", f"length {n.bit_length()}", f"top {round(10 * times.max() / n)}"]
        # Shapes enter by their share of the words, so that a long text counts as a short one does.
        vector = np.log1p(words) / np.sqrt(len(counts)) + 4 * np.sqrt(shapes / n)
        for x in extra:
            vector[place(x)] += 0.5
        again = sum(map(eq, listed, listed[1:])) / n  # words that repeat the one before
        vector[place("again")] += 4 * np.sqrt(again)
        found = np.flatnonzero(vector)
        return found, vector[found]


@dataclass
class Model:
    """Projection to latent dimensions, the labelled vectors and what each of their votes weighs."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def project(self, sparse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.stack([values.astype(np.float32) @ self.projection[at] for at, values in sparse]) if sparse else np.zeros((0, self.projection.shape[1]), np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    def scores(self, sparse: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Exact cosines with every labelled vector; the nearest ones vote."""
        if not len(self.labels):
            return np.full(len(sparse), self.prior)
        cosines = self.project(sparse) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** POWER * self.weights[near]
        total = votes.sum(axis=1)
        return np.where(total > 1e-12, (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled documents outside the held-out fold.

    ``labels`` has doc_id and quality (0 or 1; others and nulls are ignored; of
    several labels of a document, the mean decides). The share of each class
    among all usable labels corrects the votes, so classes may be sampled alike.
    Without usable labels every score is 0.5.
    """
    spark = docs.sparkSession
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    usable = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    counts = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        chosen = part if chosen is None else chosen.unionByName(part)
    ids = spark.createDataFrame([(r.doc_id, r.quality) for r in chosen.collect()], "doc_id long, quality int")  # 2 * PER_CLASS rows at most
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([a.tolist() for a, _ in found], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in found], pa.list_(pa.float32()))], names=["doc_id", "quality", "at", "v"]
            )

    rows = in_arrow(sample, sparse, "doc_id long, quality int, at array<int>, v array<float>").toArrow()
    rows = rows.sort_by("doc_id")
    prior = counts.get(1, 0) / sum(counts.values())
    if not rows.num_rows:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), prior)
    matrix = np.zeros((rows.num_rows, TERMS), np.float32)
    ats, vs = rows.column("at"), rows.column("v")
    for k in range(rows.num_rows):
        matrix[k, ats[k].values.to_numpy(zero_copy_only=False)] = vs[k].values.to_numpy(zero_copy_only=False)
    idf = np.log((1 + rows.num_rows) / (1 + (matrix > 0).sum(axis=0))) + 0.3
    matrix *= idf.astype(np.float32)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    _, basis = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    basis = basis[:, ::-1][:, :DIMENSIONS]
    quality = rows.column("quality").to_numpy().astype(float)
    weight = {v: counts.get(v, 0) / max(1, (quality == v).sum()) for v in (0, 1)}
    model = Model((idf[:, None] * basis).astype(np.float32), np.zeros((0, DIMENSIONS), np.float32), quality, np.where(quality == 1, weight[1], weight[0]), prior)
    vectors = matrix @ basis.astype(np.float32)
    model.vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add a score from 0 to 1 to every document, from its whole text alone.

    A null or empty text is a text with one term, "empty"; where no labelled
    vector is near, the score is the share of good labels. Repeated rows score
    alike, an empty table stays empty, other columns pass unchanged (one named
    like ``score_col`` is replaced).
    """
    base = docs.drop(score_col)
    schema = T.StructType([*base.schema.fields, T.StructField(score_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for big in batches:
            for batch in slices(big, BLOCK):
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                scores = shared.value.scores([terms.of(x or "") for x in texts])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(scores, 0, 1), pa.float64())], names=schema.names)

    return in_arrow(base, run, schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from four fifths of the labels."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
