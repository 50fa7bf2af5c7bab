"""A corpus from quality filter to tokens: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from cairn.llm.common import bounded, documents, forget, stored, unused

#: Ids of documents that go are broadcast only up to so many (some 24 MB); beyond that, texts are shuffled to them.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't among ``gone`` (doc_id, each once); rows without one stay."""
    return docs.join(bounded(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; what it rejects goes, null and empty texts as it scores them. Repeated rows are scored alike."""
    score = unused(docs, "_score")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, score_col=score).where(F.col(score) >= quality.GOOD).select(*docs.columns)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that earlier documents hold, n_chars anew; documents of which nothing is left go.

    Null and empty texts stay; repeated rows of one text are one document.
    """
    lines, removed = unused(docs, "n_lines"), unused(docs, "n_removed")
    found = line_dedup.dedup_blocks(docs, lines_col=lines, removed_col=removed).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    return found.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar texts, the document with the smallest doc_id. Rows that repeat a doc_id are one document; rows without one stay."""
    groups = stored(ngram_join.jaccard_groups(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull()), "groups")
    smaller = stored(groups.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct(), "smaller")
    again = stored(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    forget(groups)
    kept = without(docs, smaller)
    if again.isEmpty():
        return kept
    repeated = kept.join(bounded(again, BROADCAST_IDS), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return without(kept, again).unionByName(repeated)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows that repeat a doc_id go together, rows without one stay."""
    found = decontaminate.scan(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, stored(found.where("contaminated").select("doc_id").distinct(), "contaminated"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text and whether they decode to it. A null or empty text has none, which decode to an empty text; rows are independent."""
    import public_tokenizers

    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"), decoded_col="decoded")
    return done.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("line_dedup", new_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", no_benchmark),
    ("bpe", tokens),
]

#: SQL expresses neither the classifier nor patience alignment; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        done = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if k:
            forget(docs)
        docs = done
    return docs
