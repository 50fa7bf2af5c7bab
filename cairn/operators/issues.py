"""Counts of a snapshot and the sections of its issue report.

A section that wasn't executed has null counts; one that found nothing has 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import diagnostic_class, issue_visible, normalize_family

from .history import attempt_status_counts


DENSE = 100  # fixed value: warnings of one entry that make it worth a look
BAD_HASH, BAD_META, BAD_FORMAT = ["error", "unstable"], ["error", "timeout", "unstable"], ["invalid", "timeout", "error", "unstable"]
PROBLEM_ATTEMPT = ["failed", "timeout", "unstable", "tool_error", "invalid"]


def long_counts(df: DataFrame, section: str, *keys: Column) -> DataFrame:
    """section, key and value for counts by one key."""
    return df.groupBy(*[k.cast("string").alias("key") for k in keys]).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), "key", "value")


def snapshot_counts(entries: DataFrame, dirs: DataFrame, roots: DataFrame, errors: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """section, key, value: all counts that a snapshot declares of itself."""
    total = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).select(F.expr("stack(2, 'entries', entries, 'bytes', bytes) as (key, value)"))
    one = lambda df, key: df.agg(F.count("*").alias("value")).select(F.lit("total").alias("section"), F.lit(key).alias("key"), "value")
    parts = [
        total.select(F.lit("total").alias("section"), "key", "value"), one(dirs, "dirs"), one(errors, "errors"), one(dirs.where("enum_status <> 'ok'"), "dir_errors"), one(roots.where("enum_status = 'failed'"), "failed_roots"),
        long_counts(entries, "kind", F.col("media_kind")), long_counts(entries, "meta_status", F.col("meta_status")), long_counts(entries, "hash_status", F.col("hash_status")), long_counts(diagnostics, "severity", F.col("severity")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def flags(entries: DataFrame, dirs: DataFrame, roots: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: has_file_issues, has_unstable, has_gaps."""
    some = lambda df, cond: df.agg(F.coalesce(F.max(cond.cast("int")), F.lit(0)).alias("x"))
    hit = lambda df, cond, name: some(df, cond).select((F.col("x") == 1).alias(name))
    issues = hit(entries, F.col("meta_status").isin("error", "timeout") | (F.col("hash_status") == "error"), "by_status").join(hit(errors, issue_visible(F.col("error_code"), F.col("message")), "by_error"), F.lit(True))
    gaps = hit(dirs, F.col("enum_status") != "ok", "dir_gap").join(hit(roots, F.col("enum_status") == "failed", "root_gap"), F.lit(True))
    unstable = hit(entries, (F.col("meta_status") == "unstable") | (F.col("hash_status") == "unstable"), "has_unstable")
    return issues.join(unstable, F.lit(True)).join(gaps, F.lit(True)).select((F.col("by_status") | F.col("by_error")).alias("has_file_issues"), "has_unstable", (F.col("dir_gap") | F.col("root_gap")).alias("has_gaps"))


def metadata_coverage(entries: DataFrame) -> DataFrame:
    """One row of totals and percentages (four digits); percentages are null where nothing applies."""
    status = F.col("meta_status")
    applicable = ~status.isin("not_applicable", "skipped")
    out = entries.agg(F.count("*").alias("total"), F.count_if(applicable).alias("applicable"), F.count_if(applicable & (status != "pending")).alias("attempted"), F.count_if(status == "done").alias("successful"))
    percent = lambda c: F.bround(F.try_divide(F.col(c) * 100.0, F.col("applicable").cast("double")), 4).alias(f"{c}_percent")
    return out.select("*", percent("attempted"), percent("successful"))


def issue_flags(attempts: DataFrame) -> DataFrame:
    """One row: problems of sources, tools and time among latest attempts, told by their codes."""
    code, tool = F.coalesce("error_code", F.lit("")), F.col("error_code").like("tool\\_%")
    return attempts.agg(F.count_if(F.coalesce(tool, F.lit(False))).alias("tool_issues"), F.count_if(F.col("status") == "timeout").alias("timeout_issues"), F.count_if(F.col("status").isin("failed", "unstable", "invalid") & ~code.like("tool\\_%")).alias("source_issues"))


def kind_rollup(entries: DataFrame) -> DataFrame:
    return entries.groupBy("media_kind").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def effective_profile(entries: DataFrame, hashes: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row: rows with payloads, with file ids and with valid hashes."""
    ids = entries.agg(F.count_if(F.col("file_id").isNotNull()).alias("file_ids"))
    return payloads.agg(F.count("*").alias("payloads")).join(ids, F.lit(True)).join(hashes.agg(F.count_if(F.col("status") == "valid").alias("valid_hashes")), F.lit(True))


def diagnostic_rollup(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics by severity, code and field, without those that only say a format isn't known."""
    seen = diagnostics.where(issue_visible(F.col("diagnostic_code"), F.col("message")))
    return seen.groupBy("severity", "diagnostic_code", "field_name").agg(F.count("*").alias("n"))


def evidence_gaps(diagnostics: DataFrame) -> DataFrame:
    """Validation rows that say a payload of an earlier snapshot is no longer there."""
    return diagnostics.where((F.col("severity") == "validation") & F.col("diagnostic_code").like("historical\\_%\\_payload\\_unavailable")).agg(F.count("*").alias("n"))


def enumeration(roots: DataFrame, dirs: DataFrame) -> DataFrame:
    """root_label, rel_path and enum_status of failed roots and of directories that weren't listed."""
    return roots.where("enum_status = 'failed'").select("root_label", F.lit("").alias("rel_path"), "enum_status").unionByName(dirs.where("enum_status <> 'ok'").select("root_label", "rel_path", "enum_status"))


def hash_section(entries: DataFrame, errors: DataFrame, attempts: DataFrame, executed: bool = True) -> DataFrame:
    """One row: affected entries, and records (errors, attempts, and statuses with neither)."""
    bad = entries.where(F.col("hash_status").isin(BAD_HASH)).select("entry", F.lit(1).alias("by_status"), F.lit(0).alias("errors"), F.lit(0).alias("attempts"))
    err = errors.where("stage = 'hash'").groupBy("entry").agg(F.count("*").alias("errors")).select("entry", F.lit(0).alias("by_status"), "errors", F.lit(0).alias("attempts"))
    tried = attempts.where("stage = 'hash'").where(F.col("status").isin(PROBLEM_ATTEMPT)).select("entry", F.lit(0).alias("by_status"), F.lit(0).alias("errors"), F.lit(1).alias("attempts"))
    every = bad.unionByName(err).unionByName(tried).groupBy("entry").agg(F.max("by_status").alias("s"), F.sum("errors").alias("e"), F.sum("attempts").alias("a"))
    row = every.agg(F.count("*").alias("affected"), F.coalesce(F.sum(F.col("e") + F.col("a") + F.when((F.col("s") == 1) & (F.col("e") + F.col("a") == 0), 1).otherwise(0)), F.lit(0)).alias("records"))
    return row if executed else row.select(F.lit(None).cast("long").alias("affected"), F.lit(None).cast("long").alias("records"))


def classified(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.withColumn("class", diagnostic_class(F.col("severity"), F.col("diagnostic_code"), F.col("message"))).withColumn("family", normalize_family(F.col("diagnostic_code")))


CLASS_ORDER = ["need_action", "candidate", "validation", "warning", "minor", "information", "unsupported"]


def metadata_section(entries: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A row for every entry with something to report: counts by class, families, and the message that matters most.

    Entries whose only reports are of unknown formats are left out; an entry with
    warnings alone is in if it has DENSE of them.
    """
    found = classified(diagnostics)
    n = lambda *words: F.count_if(F.col("class").isin(*words))
    rank = F.array_position(F.array(*map(F.lit, CLASS_ORDER)), F.col("class"))
    per = found.groupBy("entry").agg(
        n("need_action").alias("actions"), n("candidate").alias("candidates"), n("warning", "minor").alias("warnings"), n("validation").alias("validations"), n("unsupported").alias("unsupported"),
        F.countDistinct("family").alias("families"), F.min_by("message", F.struct(rank, -F.col("diagnostic_pk"))).alias("message"),
    )
    both = entries.select("entry", "meta_status").join(per, "entry", "left").na.fill(0)
    only_unknown = (F.col("unsupported") > 0) & (F.col("actions") + F.col("candidates") + F.col("warnings") + F.col("validations") == 0)
    level = F.when((F.col("actions") > 0) | (F.col("meta_status").isin(BAD_META) & ~only_unknown), "need_action").when((F.col("candidates") > 0) | (F.col("warnings") >= DENSE), "candidate").when(F.col("validations") > 0, "information")
    return both.withColumn("level", level).where("level is not null")


def format_section(checks: DataFrame) -> DataFrame:
    return checks.where(F.col("status").isin(*BAD_FORMAT, "unsupported")).groupBy("validator", "status").agg(F.count("*").alias("n"))


def performance_section(found: DataFrame) -> DataFrame:
    """One row: reads that are surely and perhaps slow."""
    return found.agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "low").alias("low"))


def slow_reads(performance: DataFrame, entries: DataFrame, limit: int = 200) -> DataFrame:
    """The first surely slow reads by root and path key, with their rate (MiB a second; null where no time went by) and what they were told by, and the number of all.

    performance: root_label, rel_path and what ``read_performance`` has; entries: root_label, rel_path, path_key.
    """
    slow = performance.where("candidate_confidence = 'high'")
    rate = F.when(F.col("elapsed_seconds") > 0, F.col("bytes_read") / F.col("elapsed_seconds") / (1 << 20))
    facts = ["size_bytes", "bytes_read", "elapsed_seconds", "active_read_seconds", "stall_count", "longest_stall_seconds", "final_offset", "session_id", "stage", "origin"]
    rows = slow.join(entries.select("root_label", "rel_path", "path_key"), ["root_label", "rel_path"]).select("root_label", "path_key", "rel_path", "attempt_id", F.col("candidate_reason").alias("reason"), *facts, F.bround(rate, 3).alias("mib_per_second"))
    return rows.orderBy("root_label", "path_key", "attempt_id").limit(limit).join(slow.agg(F.count("*").alias("total")), F.lit(True))


def slow_read_counts(performance: DataFrame) -> DataFrame:
    """One row: files with surely and perhaps slow reads, and such reads."""
    high, low = F.col("candidate_confidence") == "high", F.col("candidate_confidence") == "low"
    entry = F.struct("root_label", "rel_path")
    return performance.agg(F.countDistinct(F.when(high, entry)).alias("issue_files"), F.count_if(high).alias("issue_records"), F.countDistinct(F.when(low, entry)).alias("low_confidence_files"), F.count_if(low).alias("low_confidence_records"))


def execution_counts(checks: DataFrame, attempts: DataFrame, performance: DataFrame) -> DataFrame:
    """section, key and value: format checks by status, latest attempts by stage and status, reads by confidence. attempts: entry, stage, attempt_number, status."""
    latest = attempt_status_counts(attempts).select(F.lit("latest_attempt").alias("section"), F.concat_ws(".", "stage", "status").alias("key"), F.col("n").alias("value"))
    return long_counts(checks, "format_status", F.col("status")).unionByName(latest).unionByName(long_counts(performance, "performance_confidence", F.col("candidate_confidence")))


def runtime_section(sessions: DataFrame, stages: DataFrame, events: DataFrame) -> DataFrame:
    """kind, id and detail of failed or abandoned sessions, failed stages, and tools that were cut off (told by the event's payload)."""
    ended = sessions.where(F.col("status").isin("failed", "abandoned") & (F.coalesce("end_reason", F.lit("")) != "tool_circuit_open")).select(F.lit("session").alias("kind"), F.col("session_id").alias("id"), F.col("status").alias("detail"))
    failed = stages.where(F.col("status").startswith("failed")).select(F.lit("stage").alias("kind"), F.col("stage").alias("id"), F.col("status").alias("detail"))
    cut = events.where("event_type = 'tool_circuit_open'").select(F.lit("tool").alias("kind"), F.coalesce(F.try_variant_get(F.try_parse_json("payload"), "$.tool", "string"), F.lit("unknown")).alias("id"), F.try_variant_get(F.try_parse_json("payload"), "$.signature", "string").alias("detail"))
    return ended.unionByName(failed).unionByName(cut)


def capped(details: DataFrame, section: str, *order: Column, limit: int = 200) -> DataFrame:
    """The first ``limit`` rows of each section, with the section's total. Partial limits bound what any task sorts."""
    totals = details.groupBy(section).agg(F.count("*").alias("total"))
    salted = latest_n(details.withColumn("_part", F.pmod(F.xxhash64(*details.columns), F.lit(64))), [section, "_part"], limit, *order)
    return latest_n(salted.drop("_part"), [section], limit, *order).join(totals, section)


def latest_n(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def reportable(sections: DataFrame) -> DataFrame:
    """Whether any executed section (section, n; null if not executed) found something."""
    return sections.agg((F.coalesce(F.max("n"), F.lit(0)) > 0).alias("reportable"))


def legacy_sections(entries: DataFrame, errors: DataFrame, roots: DataFrame, dirs: DataFrame) -> DataFrame:
    """section and n of the older report: visible errors, bad statuses that aren't just unknown formats, failed roots and directories."""
    shown = issue_visible(F.col("error_code"), F.col("message"))
    only_unknown = errors.groupBy("entry").agg(F.max(shown.cast("int")).alias("v")).where("v = 0").select("entry")
    bad = entries.where(F.col("meta_status").isin(BAD_META) | F.col("hash_status").isin(BAD_HASH)).join(only_unknown, "entry", "left_anti")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
    return one(errors.where(shown), "errors").unionByName(one(bad, "status")).unionByName(one(roots.where("enum_status = 'failed'"), "roots")).unionByName(one(dirs.where("enum_status <> 'ok'"), "dirs"))


def pending_by_kind(entries: DataFrame) -> DataFrame:
    """Entries whose metadata are still to be read, by kind."""
    return entries.where("meta_status = 'pending'").groupBy(F.coalesce("media_kind", F.lit("unknown")).alias("media_kind")).agg(F.count("*").alias("n"))


def first_details(details: DataFrame, limit: int = 200) -> DataFrame:
    """The first rows of a metadata section with their place: what needs action first, then by root and path key. details: level, root_label, path_key, ..."""
    action = (F.col("level") == "need_action").cast("int")
    top = details.orderBy(action.desc(), "root_label", "path_key").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(action.desc(), "root_label", "path_key")).cast("long"))


def report(sections: dict[str, DataFrame | None], spark) -> DataFrame:
    """One row a section of the issue report. sections: name to one row of issue_files, issue_records and, where known, unsupported_files and low_confidence_records; None if the section wasn't executed."""
    fields = ["issue_files", "issue_records", "unsupported_files", "low_confidence_records"]
    out = None
    for name, df in sections.items():
        ran = df is not None
        row = df if ran else spark.range(1)
        shaped = row.select(F.lit(name).alias("section_id"), F.lit("executed" if ran else "not_executed").alias("execution"), *[(F.col(f) if ran and f in df.columns else F.lit(None)).cast("long").alias(f) for f in fields], F.lit(None if ran else "not part of this run").cast("string").alias("reason"))
        out = shaped if out is None else out.unionByName(shaped)
    return out
