"""A new listing against the recorded state; hashes that need not be computed again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import reuse_decision


def reconcile(recorded: DataFrame, listed: DataFrame, keys: list[str], stats: list[str], statuses: list[str]) -> DataFrame:
    """The recorded rows after a new listing, with ``change``: inserted, updated, kept or removed.

    A listed row takes the new stats; where they differ its statuses go back to
    pending, else they stay. Rows that are no longer listed are returned as
    removed, with their old values.
    """
    old = recorded.select(*keys, F.struct(*stats).alias("_old"), *statuses)
    new = listed.select(*keys, F.struct(*stats).alias("_new"))
    both = old.join(new, keys, "full_outer")
    same = F.col("_old").eqNullSafe(F.col("_new"))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "removed").when(same, "kept").otherwise("updated")
    kept = F.coalesce("_new", "_old")
    states = [F.when(F.col("_new").isNull() | same, F.col(s)).otherwise("pending").alias(s) for s in statuses]
    return both.select(*keys, *[kept[s].alias(s) for s in stats], *states, change.alias("change"))


def rescan(recorded: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Entries (keys, size, mtime, placeholder) that changed or went since they were recorded; placeholders are left out."""
    now = listed.select(*keys, F.struct("size", "mtime").alias("_now"))
    both = recorded.where(~F.col("placeholder")).join(now, keys, "left")
    return both.where(~F.struct("size", "mtime").eqNullSafe(F.col("_now"))).select(*keys, F.when(F.col("_now").isNull(), "gone").otherwise("changed").alias("why"), F.lit("unstable").alias("meta_status"), F.lit("unstable").alias("hash_status"))


def reuse_plan(entries: DataFrame, previous: DataFrame) -> DataFrame:
    """For every entry whether the previous snapshot's hash serves, and why. Both: root_label, path_key, size, mtime, placeholder, volume_serial, file_index_hex; previous also hash_hex.

    A path key that stands twice in the previous snapshot is ambiguous, and
    serves nothing, as does one without a hash.
    """
    facts = ["size", "mtime", "placeholder", "volume_serial", "file_index_hex"]
    before = previous.groupBy("root_label", "path_key").agg(F.count("*").alias("_times"), F.first(F.struct(*facts, "hash_hex")).alias("_before"))
    both = entries.withColumn("_now", F.struct(*facts)).join(before, ["root_label", "path_key"], "left")
    decided = both.withColumn("_d", reuse_decision(F.col("_now"), F.when(F.col("_times") == 1, F.col("_before"))))
    basis = F.when(F.col("_times") > 1, "ambiguous_path_key").when(F.col("_d.reuse") & F.col("_before.hash_hex").isNull(), "no_previous_hash").otherwise(F.col("_d.basis"))
    return decided.select("root_label", "path_key", basis.startswith("size+").alias("reuse"), basis.alias("basis"), F.when(basis.startswith("size+"), F.col("_before.hash_hex")).alias("hash_hex"))


def hash_stage(entries: DataFrame, plan: DataFrame, computed: DataFrame) -> DataFrame:
    """hash_status, hash and origin of pending entries: skipped placeholders, reused hashes, and computed ones (root_label, path_key, status, hash_hex)."""
    both = entries.join(plan.select("root_label", "path_key", "reuse", F.col("hash_hex").alias("_reused")), ["root_label", "path_key"], "left")
    both = both.join(computed.select("root_label", "path_key", F.col("status").alias("_status"), F.col("hash_hex").alias("_computed")), ["root_label", "path_key"], "left")
    state = F.when(F.col("_status") == "valid", "done").when(F.col("_status") == "failed", "error").when(F.col("_status") == "unstable", "unstable").otherwise("pending")
    reuse = F.coalesce("reuse", F.lit(False))
    return both.select(
        "root_label", "path_key", F.when(F.col("placeholder"), "skipped").when(reuse, "done").otherwise(state).alias("hash_status"),
        F.when(~F.col("placeholder"), F.when(reuse, F.col("_reused")).otherwise(F.col("_computed"))).alias("hash_hex"), F.when(F.col("placeholder"), F.lit(None)).when(reuse, "reused").when(F.col("_status").isNotNull(), "computed").alias("origin"),
    )


def error_rate_guard(outcomes: DataFrame, warn: float = 0.2, abort: float = 0.5, least: int = 20) -> str:
    """ok, warn or abort, by the share of errors among at least ``least`` outcomes (hash_status)."""
    n, bad = outcomes.agg(F.count("*"), F.count_if(F.col("hash_status") == "error")).first()
    return "ok" if n < least or bad <= warn * n else "warn" if bad <= abort * n else "abort"


def previous_admission(counts: DataFrame) -> DataFrame:
    """Whether a snapshot may lend hashes. counts: one row of has_gaps, has_unstable, hash_failures, flags_recorded, flags_found."""
    reason = F.when(F.col("flags_recorded") != F.col("flags_found"), "flags_differ").when(F.col("has_gaps"), "gaps").when(F.col("hash_failures") > 0, "hash_failures").when(F.col("has_unstable"), "unstable")
    return counts.select(reason.isNull().alias("admitted"), reason.alias("reason"))


def independent_verify(sample: DataFrame, again: DataFrame) -> DataFrame:
    """Sampled hashes (key, hash_hex, size, mtime) against two computations anew (key, first, second, size, mtime).

    A first mismatch isn't the last word: only if neither method gives the
    record's hash, or they differ, does it count; a file that changed meanwhile
    says nothing.
    """
    both = sample.join(again.select("key", "first", "second", F.struct("size", "mtime").alias("_now")), "key", "left")
    moved = ~F.struct("size", "mtime").eqNullSafe(F.col("_now"))
    matched = (F.col("first") == F.col("hash_hex")) | ((F.col("second") == F.col("hash_hex")) & (F.col("first") == F.col("second")))
    outcome = F.when(F.col("_now").isNull() | moved, "verify_source_changed").when(F.coalesce(matched, F.lit(False)), "matched").otherwise("verify_mismatch")
    return both.select("key", outcome.alias("outcome"), F.when(outcome != "matched", "unstable").alias("hash_status"))
