"""Attempts, their current state, and the runs of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import attempt_to_current

from .ranking import latest_by

NOT_TERMINAL = ["cancelled", "abandoned", "running"]


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The attempt with the largest number of each entry and stage."""
    return latest_by(attempts, ["entry", "stage"], "attempt_number")


def next_attempt_number(attempts: DataFrame) -> DataFrame:
    return attempts.groupBy("entry", "stage").agg((F.max("attempt_number") + 1).alias("next_number"))


def current_status(attempts: DataFrame) -> DataFrame:
    """entry, stage and what the latest attempt makes of the current status."""
    return latest_attempt(attempts).select("entry", "stage", "attempt_number", "status", attempt_to_current(F.col("stage"), F.col("status")).alias("current"))


def attempt_status_counts(attempts: DataFrame) -> DataFrame:
    return latest_attempt(attempts).groupBy("stage", "status").agg(F.count("*").alias("n"))


def apply_attempts(current: DataFrame, attempts: DataFrame) -> DataFrame:
    """``current`` (entry, stage, status) with the statuses of newer attempts."""
    done = current_status(attempts).select("entry", "stage", "current")
    return current.join(done, ["entry", "stage"], "left").select("entry", "stage", F.coalesce("current", "status").alias("status"))


def recover_interrupted(attempts: DataFrame, current: DataFrame, stages: DataFrame) -> dict[str, DataFrame]:
    """After a crash: running attempts are abandoned, entries in process pending, running stages failed but recoverable."""
    change = lambda df, old, new: df.withColumn("status", F.when(F.col("status") == old, new).otherwise(F.col("status")))
    return {"attempts": change(attempts, "running", "abandoned"), "current": change(current, "processing", "pending"), "stages": change(stages, "running", "failed_recoverable")}


def retry_selection(status: Column, placeholder: Column, mode: str) -> Column:
    """Whether an entry is put back: ``transient`` takes errors, ``all_unsuccessful`` unstable and skipped ones, too; never placeholders."""
    wanted = ["error"] if mode == "transient" else ["error", "unstable", "skipped"]
    return status.isin(wanted) & ~placeholder


def hash_progress(entries: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row of totals. entries: entry, size, hash_status, reused; a timeout is an error whose latest attempt timed out."""
    last = latest_attempt(attempts.where("stage = 'hash'")).select("entry", (F.col("status") == "timeout").alias("late"))
    both = entries.join(last, "entry", "left")
    n = lambda cond: F.count_if(cond)
    status, late = F.col("hash_status"), F.coalesce("late", F.lit(False))
    return both.agg(
        F.count("*").alias("total"), n(status != "pending").alias("processed"), n(status == "done").alias("done"), n((status == "done") & F.col("reused")).alias("reused"), n((status == "error") & late).alias("timeout"),
        n((status == "error") & ~late).alias("error"), n(status == "unstable").alias("unstable"), n(status == "skipped").alias("skipped"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(status == "done", F.col("size"))), F.lit(0)).alias("bytes_done"),
    )


def verify_rollup(attempts: DataFrame) -> DataFrame:
    """Outcomes of the latest verification attempts that are final. Needs columns status, error_code and retriable."""
    last = latest_attempt(attempts).where(~F.col("status").isin(NOT_TERMINAL) & ~((F.col("status") == "tool_error") & F.col("retriable")))
    mismatch = F.col("status").isin("invalid", "unstable") & (F.coalesce("error_code", F.lit("")) == "verify_mismatch")
    outcome = F.when(F.col("status") == "succeeded", "matched").when(mismatch, "mismatched").when(F.col("status").isin("tool_error", "timeout"), F.col("status")).otherwise("unstable")
    return last.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def failure_runs(outcomes: DataFrame, key: str, order: list[str], signature: Column, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` failures with one signature; a null signature is a success and ends a run.

    Returns key, signature, length, and the first and last row of the run by the
    first column of ``order``. A key's rows are sorted together: keys are single
    tools or users, whose rows fit a task's sort.
    """
    w = Window.partitionBy(key).orderBy(*order)
    marked = outcomes.withColumn("_sig", signature).withColumn("_new", (~F.col("_sig").eqNullSafe(F.lag("_sig").over(w))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_sig is not null")
    return runs.groupBy(key, "_run", F.col("_sig").alias("signature")).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).where(F.col("length") >= least).drop("_run")


def circuit_breaker(outcomes: DataFrame, key: str, order: list[str], signature: Column, least: int = 3) -> DataFrame:
    """Per tool: where the run that reaches ``least`` failures stops the stage, and how many rows come after."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = outcomes.withColumn("_sig", signature).withColumn("_row", F.row_number().over(w)).withColumn("_new", (~F.col("_sig").eqNullSafe(F.lag("_sig").over(w))).cast("int"))
    runs = numbered.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = runs.withColumn("_turn", F.row_number().over(Window.partitionBy(key, "_run").orderBy(*order)))
    cut = inside.where((F.col("_turn") == least) & F.col("_sig").isNotNull()).groupBy(key).agg(F.min("_row").alias("cut"), F.min_by("_sig", "_row").alias("signature"))
    return cut.join(numbered.groupBy(key).agg(F.count("*").alias("n")), key).select(key, "signature", F.col("cut").cast("long").alias("processed"), (F.col("n") - F.col("cut")).alias("not_processed"))
