"""Verification of files against a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import corrupt_warning, is_raw_candidate, parse_tool_text, valid_digest

KEY = ["root_label", "rel_path"]


def stat_check(baseline: DataFrame, listed: DataFrame) -> DataFrame:
    """matched, changed or missing for every entry of the baseline, with size and mtime of both."""
    now = listed.select(*KEY, F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"), F.lit(True).alias("_there"))
    both = baseline.select(*KEY, "size", "mtime").join(now, KEY, "left")
    same = F.col("size").eqNullSafe(F.col("now_size")) & F.col("mtime").eqNullSafe(F.col("now_mtime"))
    return both.select(*KEY, "size", "mtime", "now_size", "now_mtime", F.when(F.col("_there").isNull(), "missing").when(same, "matched").otherwise("changed").alias("status"))


def hash_check(baseline: DataFrame, computed: DataFrame) -> DataFrame:
    """Outcome for every entry. computed: KEY, outcome (valid, missing, unstable, timeout, tool_error) and hash_hex."""
    both = baseline.select(*KEY, valid_digest(F.col("hash_hex")).alias("expected")).join(computed.select(*KEY, "outcome", F.col("hash_hex").alias("found")), KEY, "left")
    outcome = F.coalesce("outcome", F.lit("missing"))
    status = F.when(F.col("expected").isNull(), "unverifiable").when(outcome != "valid", outcome).when(F.col("found") == F.col("expected"), "matched").otherwise("mismatched")
    return both.select(*KEY, "expected", "found", status.alias("status"))


def patrol(baseline: DataFrame, listed: DataFrame, computed: DataFrame) -> DataFrame:
    """One row: problems of the stat check, then of the hash check over what the first left, and whether all is well."""
    stat = stat_check(baseline, listed)
    sound = baseline.join(stat.where("status <> 'matched'"), KEY, "left_anti")
    hashed = hash_check(sound, computed)
    a = stat.agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "changed").alias("changed"))
    b = hashed.agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(~F.col("status").isin("matched", "unverifiable")).alias("hash_problems"), F.count_if(F.col("status") == "unverifiable").alias("unverifiable"))
    return a.join(b, F.lit(True)).withColumn("ok", (F.col("missing") == 0) & (F.col("changed") == 0) & (F.col("hash_problems") == 0))


def format_summary(checks: DataFrame) -> DataFrame:
    """One row of counts over status; what isn't supported doesn't count as checked."""
    words = ["valid", "unsupported", "invalid", "timeout", "error", "missing", "unstable"]
    return checks.agg(*[F.count_if(F.col("status") == w).alias(w) for w in words], F.count_if(F.col("status") != "unsupported").alias("checked"))


def tool_verdict(kind: Column, text: Column, exit_code: Column, streams: Column) -> Column:
    """Verdict from recorded output. kind: media, 7z or ole; text: "Tag : value" lines; streams: number of streams, null if not read."""
    said = parse_tool_text(F.coalesce(text, F.lit("")))
    wrong = F.exists(said, lambda x: (x["tag"] == "Error") | ((x["tag"] == "Warning") & corrupt_warning(x["value"])))
    media = F.when(wrong | (F.coalesce(streams, F.lit(1)) < 1), "invalid").when(F.coalesce(exit_code, F.lit(0)) != 0, "error").otherwise("valid")
    packed = F.when(exit_code == 0, "valid").when(F.lower(F.coalesce(text, F.lit(""))).rlike("wrong password|encrypted"), "unsupported").when(exit_code.isin(1, 2), "invalid").otherwise("error")
    return F.when(kind == "media", media).when(kind.isin("7z", "ole"), packed).otherwise("unsupported")


def raw_summary(entries: DataFrame, decodes: DataFrame) -> DataFrame:
    """One row: RAW candidates, how their latest decoding ended, and what it gave. entries: key, name, size, mtime; decodes: key, status, size, mtime, width, height, decoded_bytes."""
    wanted = entries.where(is_raw_candidate(F.col("name")))
    both = wanted.join(decodes.select("key", "status", F.struct("size", "mtime").alias("_then"), (F.col("width") * F.col("height")).alias("pixels"), "decoded_bytes"), "key", "left")
    moved = F.col("_then").isNotNull() & ~F.struct("size", "mtime").eqNullSafe(F.col("_then"))
    both = both.withColumn("state", F.when(moved | F.col("status").isNull(), "unverifiable").otherwise(F.col("status")))
    ok = F.col("state") == "valid"
    return both.agg(F.count("*").alias("candidates"), *[F.count_if(F.col("state") == w).alias(w) for w in ("valid", "unsupported", "unverifiable", "invalid")], F.coalesce(F.sum(F.when(ok, F.col("pixels"))), F.lit(0)).alias("pixels"), F.coalesce(F.sum(F.when(ok, F.col("decoded_bytes"))), F.lit(0)).alias("decoded_bytes"))


def tool_failure_groups(failures: DataFrame, samples: int = 3) -> DataFrame:
    """One row a signature: files affected, and the first paths. A tool's failure isn't the files'.

    The first paths are picked in parts before they meet, so a signature may have any number of rows.
    """
    parts = failures.select("signature", "path").withColumn("_part", F.pmod(F.xxhash64("path"), F.lit(256)))
    first = lambda df, *keys: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("path"))).where(F.col("_n") <= samples).drop("_n")
    # Of each part's distinct paths, ``samples`` at most.
    few = first(first(parts.distinct(), "signature", "_part"), "signature").groupBy("signature").agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return failures.groupBy("signature").agg(F.count("*").alias("affected")).join(few, "signature")


def problem_counts(problems: DataFrame) -> DataFrame:
    """Problems by status; a row may stand for several files (affected)."""
    return problems.groupBy("status").agg(F.sum(F.coalesce("affected", F.lit(1))).cast("long").alias("n"))


def conclusion(sections: DataFrame) -> DataFrame:
    """One word for all sections (failed, stopped, issues, unavailable, unverifiable: booleans or counts)."""
    some = lambda c: F.max(F.col(c).cast("int")) > 0
    return sections.agg(F.when(some("failed"), "failed").when(some("stopped"), "stopped").when(some("issues"), "issues_found").when(some("unavailable") | some("unverifiable"), "incomplete").otherwise("passed").alias("conclusion"))


def report_rows(stat: DataFrame, hashes: DataFrame, checks: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """section, checked and problems of each part of a verification; null where a part wasn't executed."""
    count = lambda df, section, fine: df.agg(F.lit(section).alias("section"), F.count("*").alias("checked"), F.count_if(~F.col("status").isin(*fine)).alias("problems"))
    missing = lambda section: stat.sparkSession.range(1).select(F.lit(section).alias("section"), F.lit(None).cast("long").alias("checked"), F.lit(None).cast("long").alias("problems"))
    parts = [count(stat, "stat", ["matched"]), count(hashes.where("status <> 'unverifiable'"), "hash", ["matched"])]
    parts.append(count(checks.where("status <> 'unsupported'"), "format", ["valid"]) if checks is not None else missing("format"))
    parts.append(raw.select(F.lit("raw").alias("section"), (F.col("candidates") - F.col("unsupported") - F.col("unverifiable")).alias("checked"), F.col("invalid").alias("problems")) if raw is not None else missing("raw"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
