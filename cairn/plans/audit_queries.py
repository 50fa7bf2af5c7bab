"""Queries of the other operators over the driver's tables, each with its twin in SQL.

Documents stand for files (roots are sources, folders languages), labels for
statuses, events for attempts and reads (entry = user, stage = event type), line
items for the layout of disks (disk = order), customers and suppliers for
inventories.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import payload
from cairn.functions import text as fn
from cairn.operators import disks, history, issues, ranking, reconcile, stats, verify
from cairn.sources import bundle
from cairn.streaming import journal

from . import projections
from .model import SIDES, snapshot, table

SEED = "documents"


def files(s: SparkSession, d: str) -> DataFrame:
    """Documents as entries with statuses from their labels."""
    docs, labels = table(s, d, "documents"), table(s, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ext = F.element_at(F.array(*map(F.lit, ("jpg", "mp4", "pdf", "zip", "txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    both = docs.join(labels, "doc_id", "left")
    return both.select(
        F.col("doc_id").alias("entry"), F.col("source").alias("root_label"), path.alias("rel_path"), fn.path_key(path, True).alias("path_key"), ext.alias("extension"), fn.media_kind(ext).alias("media_kind"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
        F.when(F.col("quality").isNull(), "skipped").when(F.col("quality") == 1, "done").otherwise("error").alias("meta_status"), F.when(F.col("toxic").isNull(), "pending").when(F.col("toxic") == 0, "done").otherwise("unstable").alias("hash_status"), (F.col("doc_id") % 2 == 0).alias("reused"),
    )


FILES = """
f AS (SELECT *, lang || '/' || CAST(doc_id AS VARCHAR) || '.' || ext AS path FROM (SELECT doc_id, source, lang, strlen(coalesce(text, '')) AS size, ['jpg', 'mp4', 'pdf', 'zip', 'txt'][CAST(doc_id % 5 + 1 AS INTEGER)] AS ext FROM documents)),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
files AS (SELECT f.doc_id AS entry, source AS root_label, path AS rel_path, lower(path) AS path_key, ext AS extension, CASE ext WHEN 'jpg' THEN 'photo_jpeg' WHEN 'mp4' THEN 'video_mp4' WHEN 'pdf' THEN 'document' WHEN 'zip' THEN 'archive' ELSE 'other' END AS media_kind, size,
  CASE WHEN quality IS NULL THEN 'skipped' WHEN quality = 1 THEN 'done' ELSE 'error' END AS meta_status, CASE WHEN toxic IS NULL THEN 'pending' WHEN toxic = 0 THEN 'done' ELSE 'unstable' END AS hash_status, f.doc_id % 2 = 0 AS reused FROM f LEFT JOIN l USING (doc_id))"""


def attempts(s: SparkSession, d: str) -> DataFrame:
    """Events as attempts: the stage is the type, the status goes by the id."""
    status = F.element_at(F.array(*map(F.lit, ("succeeded", "succeeded", "timeout", "unstable", "failed", "cancelled", "unsupported"))), (F.col("event_id") % 7 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, ("hash", "metadata", "format"))), (F.col("event_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select(F.col("user_id").alias("entry"), stage.alias("stage"), F.col("event_id").alias("attempt_number"), status.alias("status"), F.when(F.col("event_id") % 11 == 0, "verify_mismatch").when(F.col("event_id") % 13 == 0, "tool_crash").alias("error_code"), (F.col("event_id") % 2 == 0).alias("retriable"))


ATTEMPTS = """
a AS (SELECT user_id AS entry, ['hash', 'metadata', 'format'][CAST(event_id % 3 + 1 AS INTEGER)] AS stage, event_id AS attempt_number, ['succeeded', 'succeeded', 'timeout', 'unstable', 'failed', 'cancelled', 'unsupported'][CAST(event_id % 7 + 1 AS INTEGER)] AS status,
  CASE WHEN event_id % 11 = 0 THEN 'verify_mismatch' WHEN event_id % 13 = 0 THEN 'tool_crash' END AS error_code, event_id % 2 = 0 AS retriable FROM events),
last AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY entry, stage ORDER BY attempt_number DESC) = 1)"""


def reads(s: SparkSession, d: str) -> DataFrame:
    """Events as reads of files: sizes and seconds go by the id."""
    size = (F.lit(1 << 20) + F.col("event_id") % 5 * (1 << 20)).cast("long")
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.concat_ws("/", "event_type", fn.size_band(size).cast("string")).alias("group"), size.alias("size"), size.alias("bytes_read"), (F.lit(1.0) + F.when(F.col("event_id") % 101 == 0, 40).otherwise(F.col("event_id") % 7).cast("double")).alias("seconds"), F.when(F.col("event_id") % 211 == 0, 95.0).when(F.col("event_id") % 97 == 0, 31.0).otherwise(0.0).alias("longest_stall"))


READS = """
r AS (SELECT event_id AS id, CAST(1048576 + event_id % 5 * 1048576 AS BIGINT) AS size, event_type, 1.0 + CASE WHEN event_id % 101 = 0 THEN 40 ELSE event_id % 7 END::DOUBLE AS seconds, CASE WHEN event_id % 211 = 0 THEN 95.0 WHEN event_id % 97 = 0 THEN 31.0 ELSE 0.0 END AS stall FROM events),
rr AS (SELECT id, event_type || '/' || CAST(CAST(round_even(log2(size), 0) AS INTEGER) AS VARCHAR) AS grp, size / seconds AS rate, stall FROM r),
m AS (SELECT grp, count(*) AS n, median(rate) AS med FROM rr GROUP BY grp),
md AS (SELECT grp, n, med, median(abs(rate - med)) AS mad FROM rr JOIN m USING (grp) GROUP BY ALL),
x AS (SELECT id, grp, rate, CASE WHEN n < 8 THEN 0 WHEN mad = 0 THEN CASE WHEN rate / med <= 0.25 THEN 2 WHEN rate / med <= 0.5 THEN 1 ELSE 0 END WHEN (med - rate) / (1.4826 * mad) >= 6 AND rate / med <= 0.5 THEN 2 WHEN (med - rate) / (1.4826 * mad) >= 3.5 AND rate / med <= 0.75 THEN 1 ELSE 0 END AS g,
  CASE WHEN stall >= 90 THEN 2 WHEN stall >= 30 THEN 1 ELSE 0 END AS s FROM rr JOIN md USING (grp))"""


def diagnostics(s: SparkSession, d: str) -> DataFrame:
    """Conversation turns as diagnostics of entries."""
    k = F.col("conv_id") + F.col("turn")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    return table(s, d, "conversations").select(F.col("conv_id").alias("entry"), (F.col("conv_id") * 1000 + F.col("turn")).alias("diagnostic_pk"), pick(["warning", "error", "validation", "warning"]).alias("severity"), pick(["exiftool_reported_error", "Copy12_bad", "copy3_bad"]).alias("diagnostic_code"), pick(["[minor] odd", "Truncated data", "Unknown file type.", "plain", "JPEG format error"]).alias("message"))


DIAGNOSTICS = """
dg AS (SELECT conv_id AS entry, conv_id * 1000 + turn AS diagnostic_pk, ['warning', 'error', 'validation', 'warning'][CAST((conv_id + turn) % 4 + 1 AS INTEGER)] AS severity, ['exiftool_reported_error', 'Copy12_bad', 'copy3_bad'][CAST((conv_id + turn) % 3 + 1 AS INTEGER)] AS diagnostic_code,
  ['[minor] odd', 'Truncated data', 'Unknown file type.', 'plain', 'JPEG format error'][CAST((conv_id + turn) % 5 + 1 AS INTEGER)] AS message FROM conversations),
cl AS (SELECT *, CASE WHEN diagnostic_code = 'exiftool_reported_error' AND message = 'Unknown file type.' THEN 'unsupported' WHEN severity = 'validation' THEN 'validation'
  WHEN severity = 'warning' THEN CASE WHEN message LIKE '[minor]%' THEN 'minor' WHEN message IN ('Truncated data', 'JPEG format error', 'Unknown file type.') THEN 'candidate' ELSE 'warning' END WHEN severity = 'error' THEN 'need_action' ELSE 'information' END AS class,
  regexp_replace(diagnostic_code, '(?i)(copy)\\d+', '\\1#') AS family FROM dg)"""


def pair(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return snapshot(s, d, False)["entries"], snapshot(s, d, True)["entries"]


def reconciled(s: SparkSession, d: str) -> DataFrame:
    old, new = pair(s, d)
    return reconcile.reconcile(old.withColumn("meta_status", F.lit("done")).withColumn("hash_status", F.lit("done")), new, ["root_label", "rel_path"], ["size", "mtime"], ["meta_status", "hash_status"])


def reusable(s: SparkSession, d: str) -> DataFrame:
    old, new = pair(s, d)
    shaped = lambda df: df.withColumn("placeholder", F.col("size") % 7 == 0).withColumnsRenamed({"volume": "volume_serial", "file_id": "file_index_hex"})
    return reconcile.reuse_plan(shaped(new).drop("hash_hex"), shaped(old))


def stat_checked(s: SparkSession, d: str) -> DataFrame:
    return verify.stat_check(*pair(s, d))


def hash_checked(s: SparkSession, d: str) -> DataFrame:
    old, new = pair(s, d)
    return verify.hash_check(old, new.withColumn("outcome", F.when(F.col("unstable"), "unstable").when(F.col("hash_hex").isNull(), "tool_error").otherwise("valid")))


def layout(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("disk"), (F.col("l_linenumber") * 60).cast("long").alias("offset")).agg(F.max("l_quantity").cast("long").alias("size"))
    return disks.layout_gaps(lines, table(s, d, "orders").select(F.col("o_orderkey").alias("disk"), F.lit(500).cast("long").alias("size")))


def event_tags(s: SparkSession, d: str) -> DataFrame:
    return payload.tags(table(s, d, "events").select("event_id", F.col("props").alias("payload")), ["event_id"])


def named(s: SparkSession, d: str) -> DataFrame:
    """Functions of paths and numbers on pages."""
    url, size = F.col("url"), F.octet_length("html").cast("long")
    path = F.regexp_extract(url, r"^https?://([^?#]*)", 1)
    return table(s, d, "pages").select(
        "page_id", fn.path_key(url, True).alias("path_key"), fn.logical_path(F.lit("web"), path).alias("logical_path"), fn.parent_path(path).alias("parent"), fn.extension_of(path).alias("extension"), fn.id_hex(F.col("page_id")).alias("id_hex"), fn.ns_to_utc(F.col("page_id") * 1000000123).alias("utc"), fn.size_band(size).alias("band"),
        fn.timeout_for_size(size * 1000000).alias("timeout"), fn.format_bytes(size * 1000).alias("shown"), fn.first_float(url).alias("number"), fn.valid_digest(F.sha2(url, 256)).isNotNull().alias("digest"),
    )


def manifest(s: SparkSession, d: str) -> DataFrame:
    entries = snapshot(s, d, True)["entries"]
    shaped = entries.select("root_label", "rel_path", F.col("size").alias("size_bytes"), F.col("mtime").cast("string").alias("modified_at_utc"))
    return projections.file_manifest(shaped, entries.where("hash_hex is not null").select("root_label", "rel_path", F.lit("sha256").alias("algorithm"), F.lit("valid").alias("status"), "hash_hex"))


def shaped_history(s: SparkSession, d: str) -> DataFrame:
    events, orders = table(s, d, "events"), table(s, d, "orders")
    return projections.run_history({"event": (events.select("event_id", "event_type"), ["event_id"], None), "order": (orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], None)})


def business(s: SparkSession, d: str) -> DataFrame:
    side = snapshot(s, d, False)
    return projections.business_projection({"entries": (side["entries"].select("root_label", "rel_path", "size", "hash_hex"), ["root_label", "rel_path"], []), "dirs": (side["dirs"], ["root_label", "rel_path"], ["path_key"])})


WANTED = {"documents": ["doc_id", "text"], "pages": ["page_id", "html"], "events": ["event_id", "ts"], "labels": ["doc_id", "quality"], "lineitem": ["l_orderkey", "l_comment"]}

QUERIES = {
    "files": lambda s, d: files(s, d).select("root_label", "rel_path", fn.logical_path(F.col("root_label"), F.col("rel_path")).alias("logical_path"), "extension", "media_kind", "size", "meta_status", "hash_status"),
    "file_manifest": manifest,
    "path_functions": named,
    "snapshot_counts": lambda s, d: issues.snapshot_counts(files(s, d), snapshot(s, d, True)["dirs"], snapshot(s, d, True)["roots"], diagnostics(s, d), diagnostics(s, d)),
    "kind_rollup": lambda s, d: issues.kind_rollup(files(s, d)),
    "metadata_coverage": lambda s, d: issues.metadata_coverage(files(s, d)),
    "latest_attempt": lambda s, d: history.latest_attempt(attempts(s, d)),
    "next_attempt": lambda s, d: history.next_attempt_number(attempts(s, d)),
    "attempt_status_counts": lambda s, d: history.attempt_status_counts(attempts(s, d)),
    "current_status": lambda s, d: history.current_status(attempts(s, d)),
    "hash_progress": lambda s, d: history.hash_progress(files(s, d), attempts(s, d)),
    "verify_rollup": lambda s, d: history.verify_rollup(attempts(s, d)),
    "failure_runs": lambda s, d: history.failure_runs(attempts(s, d), "entry", ["attempt_number"], F.when(F.col("status").isin("timeout", "unstable", "failed"), F.lit("bad")), 2),
    "circuit_breaker": lambda s, d: history.circuit_breaker(attempts(s, d), "entry", ["attempt_number"], F.when(F.col("status").isin("timeout", "unstable", "failed"), F.lit("bad")), 3),
    "read_outliers": lambda s, d: stats.outliers(reads(s, d)),
    "layout_gaps": layout,
    "stratified_sample": lambda s, d: ranking.stratified_sample(files(s, d).select("entry", "size"), "size", "entry", 10, 50, SEED),
    "reconcile": reconciled,
    "reuse_plan": reusable,
    "rescan": lambda s, d: reconcile.rescan(pair(s, d)[0].withColumn("placeholder", F.lit(False)), pair(s, d)[1], ["root_label", "rel_path"]),
    "stat_check": stat_checked,
    "hash_check": hash_checked,
    "patrol": lambda s, d: verify.patrol(pair(s, d)[0], pair(s, d)[1], pair(s, d)[1].withColumn("outcome", F.when(F.col("hash_hex").isNull(), "tool_error").otherwise("valid"))),
    "problem_counts": lambda s, d: verify.problem_counts(attempts(s, d).where("status <> 'succeeded'").select("status", F.when(F.col("attempt_number") % 5 == 0, 3).cast("long").alias("affected"))),
    "tool_failure_groups": lambda s, d: verify.tool_failure_groups(attempts(s, d).where("error_code is not null").select(F.col("error_code").alias("signature"), F.lpad(F.col("attempt_number").cast("string"), 12, "0").alias("path"))).select("signature", "affected"),
    "metadata_issues": lambda s, d: issues.metadata_section(files(s, d), diagnostics(s, d)),
    "hash_issues": lambda s, d: issues.hash_section(files(s, d), diagnostics(s, d).select("entry", F.when(F.col("entry") % 3 == 0, "hash").otherwise("metadata").alias("stage")), history.latest_attempt(attempts(s, d))),
    "diagnostic_rollup": lambda s, d: issues.diagnostic_rollup(diagnostics(s, d).withColumn("field_name", F.lit("f"))),
    "issue_flags": lambda s, d: issues.issue_flags(history.latest_attempt(attempts(s, d))),
    "capped_details": lambda s, d: issues.capped(files(s, d).where("meta_status = 'error'").select("root_label", "rel_path", "entry"), "root_label", F.col("entry").asc(), limit=5),
    "payload_tags": event_tags,
    "journal_rollup": lambda s, d: journal.event_rollup(table(s, d, "events")).withColumn("value", F.round("value", 4)),
    "run_history": shaped_history,
    "business_projection": business,
    "business_digest": lambda s, d: projections.business_digest(business(s, d)),
    "capability_matrix": lambda s, d: bundle.capabilities(s, {t: table(s, d, t) for t in WANTED}, WANTED),
    "match_targets": lambda s, d: disks.match_targets(table(s, d, "customer").select(F.col("c_custkey").alias("disk")), table(s, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("disk"), F.col("o_orderkey").cast("string").alias("device"))),
    "critical_smart": lambda s, d: disks.critical_smart(table(s, d, "lineitem").select(F.col("l_orderkey").alias("disk"), (F.col("l_linenumber") + F.col("l_suppkey") % 200).cast("long").alias("id"), F.when(F.col("l_returnflag") == "R", "now").alias("when_failed"), F.col("l_quantity").cast("long").alias("raw"))),
    "volume_usage": lambda s, d: disks.volume_usage(table(s, d, "part").select("p_partkey", F.lit("c").alias("drive_letter"), F.col("p_size").cast("long").alias("size"), (F.col("p_partkey") % 40).alias("size_remaining"))),
    "constraint_violations": lambda s, d: bundle.constraint_violations({"roots": snapshot(s, d, True)["roots"], "dirs": snapshot(s, d, True)["dirs"], "entries": snapshot(s, d, True)["entries"].select("root_label", "rel_path", "path_key", F.col("size").alias("size_bytes"), F.lit(0).alias("is_placeholder"))}),
    "table_digest": lambda s, d: bundle.directory_digest(s, f"{d}/documents.parquet"),
}

_with = lambda *parts: "WITH " + ",".join(p.strip() for p in parts)

ORACLE_SQL = {
    "files": f"{_with(FILES)} SELECT root_label, rel_path, root_label || chr(92) || rel_path AS logical_path, extension, media_kind, size, meta_status, hash_status FROM files",
    "file_manifest": f"{_with(SIDES)} SELECT root AS root_label, path AS rel_path, root || chr(92) || path AS logical_path, size AS size_bytes, CAST(mtime AS VARCHAR) AS modified_at_utc, hash AS hash_hex FROM n",
    "path_functions": """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^?#]*)', 1) AS path, strlen(html) AS n FROM pages)
        SELECT page_id, lower(url) AS path_key, CASE WHEN path = '' THEN 'web' ELSE 'web' || chr(92) || path END AS logical_path, CASE WHEN path <> '' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent,
          CASE WHEN contains(path, '.') THEN lower(string_split(path, '.')[-1]) ELSE '' END AS extension, CASE WHEN page_id <> 0 THEN lower(to_hex(page_id)) END AS id_hex,
          strftime(make_timestamp(CAST(page_id * 1000000123 // 1000000000 * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST(page_id * 1000000123 % 1000000000 // 100 AS VARCHAR), 7, '0') || 'Z' AS utc,
          CAST(round_even(log2(greatest(n, 1)), 0) AS INTEGER) AS band, greatest(90, ceil(n * 1000000 / 9663676416.0) * 90)::DOUBLE AS timeout,
          CASE WHEN n * 1000 < 1000 THEN n * 1000 || ' B' WHEN n < 1000 THEN n || '.00 KB' WHEN n < 1000000 THEN printf('%d.%02d MB', (n + 5) // 10 // 100, (n + 5) // 10 % 100) ELSE printf('%d.%02d GB', (n + 5000) // 10000 // 100, (n + 5000) // 10000 % 100) END AS shown,
          CAST(nullif(regexp_extract(url, '[+-]?(?:\\d+(?:\\.\\d*)?|\\.\\d+)', 0), '') AS DOUBLE) AS number, true AS digest FROM p""",
    "snapshot_counts": f"""{_with(FILES, SIDES, DIAGNOSTICS)} SELECT 'total' AS section, 'entries' AS key, count(*) AS value FROM files UNION ALL SELECT 'total', 'bytes', CAST(coalesce(sum(size), 0) AS BIGINT) FROM files UNION ALL SELECT 'total', 'dirs', count(*) FROM nd
        UNION ALL SELECT 'total', 'errors', count(*) FROM dg UNION ALL SELECT 'total', 'dir_errors', count(*) FROM nd WHERE root = 'src7' AND path = 'de' UNION ALL SELECT 'total', 'failed_roots', 0
        UNION ALL SELECT 'kind', media_kind, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'meta_status', meta_status, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'hash_status', hash_status, count(*) FROM files GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM dg GROUP BY ALL""",
    "kind_rollup": f"{_with(FILES)} SELECT media_kind, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM files GROUP BY media_kind",
    "metadata_coverage": f"""{_with(FILES)}, c AS (SELECT count(*) AS total, count(*) FILTER (meta_status NOT IN ('not_applicable', 'skipped')) AS applicable, count(*) FILTER (meta_status NOT IN ('not_applicable', 'skipped', 'pending')) AS attempted, count(*) FILTER (meta_status = 'done') AS successful FROM files)
        SELECT *, round_even(attempted * 100.0::DOUBLE / nullif(applicable, 0), 4) AS attempted_percent, round_even(successful * 100.0::DOUBLE / nullif(applicable, 0), 4) AS successful_percent FROM c""",
    "latest_attempt": f"{_with(ATTEMPTS)} SELECT * FROM last",
    "next_attempt": f"{_with(ATTEMPTS)} SELECT entry, stage, max(attempt_number) + 1 AS next_number FROM a GROUP BY ALL",
    "attempt_status_counts": f"{_with(ATTEMPTS)} SELECT stage, status, count(*) AS n FROM last GROUP BY ALL",
    "current_status": f"""{_with(ATTEMPTS)} SELECT entry, stage, attempt_number, status, CASE stage WHEN 'hash' THEN CASE status WHEN 'succeeded' THEN 'done' WHEN 'unstable' THEN 'unstable' WHEN 'unsupported' THEN 'skipped' WHEN 'cancelled' THEN 'pending' ELSE 'error' END
        WHEN 'metadata' THEN CASE status WHEN 'succeeded' THEN 'done' WHEN 'unstable' THEN 'unstable' WHEN 'timeout' THEN 'timeout' WHEN 'unsupported' THEN 'not_applicable' WHEN 'cancelled' THEN 'pending' ELSE 'error' END
        ELSE CASE status WHEN 'succeeded' THEN 'valid' WHEN 'timeout' THEN 'timeout' WHEN 'unstable' THEN 'unstable' WHEN 'unsupported' THEN 'unsupported' WHEN 'cancelled' THEN 'pending' ELSE 'error' END END AS current FROM last""",
    "hash_progress": f"""{_with(FILES, ATTEMPTS)} SELECT count(*) AS total, count(*) FILTER (hash_status <> 'pending') AS processed, count(*) FILTER (hash_status = 'done') AS done, count(*) FILTER (hash_status = 'done' AND reused) AS reused,
        count(*) FILTER (hash_status = 'error' AND coalesce(t.status = 'timeout', false)) AS timeout, count(*) FILTER (hash_status = 'error' AND NOT coalesce(t.status = 'timeout', false)) AS error, count(*) FILTER (hash_status = 'unstable') AS unstable, count(*) FILTER (hash_status = 'skipped') AS skipped,
        CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(size) FILTER (hash_status = 'done'), 0) AS BIGINT) AS bytes_done FROM files LEFT JOIN (SELECT entry, status FROM last WHERE stage = 'hash') t USING (entry)""",
    "verify_rollup": f"""{_with(ATTEMPTS)} SELECT CASE WHEN status = 'succeeded' THEN 'matched' WHEN status IN ('invalid', 'unstable') AND coalesce(error_code, '') = 'verify_mismatch' THEN 'mismatched' WHEN status IN ('tool_error', 'timeout') THEN status ELSE 'unstable' END AS outcome, count(*) AS n
        FROM last WHERE status NOT IN ('cancelled', 'abandoned', 'running') GROUP BY ALL""",
    "failure_runs": f"""{_with(ATTEMPTS)}, s AS (SELECT entry, attempt_number, CASE WHEN status IN ('timeout', 'unstable', 'failed') THEN 'bad' END AS sig FROM a), w AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY attempt_number) - row_number() OVER (PARTITION BY entry, sig ORDER BY attempt_number) AS run FROM s)
        SELECT entry, sig AS signature, count(*) AS length, min(attempt_number) AS first, max(attempt_number) AS last FROM w WHERE sig IS NOT NULL GROUP BY entry, sig, run HAVING count(*) >= 2""",
    "circuit_breaker": f"""{_with(ATTEMPTS)}, s AS (SELECT entry, row_number() OVER (PARTITION BY entry ORDER BY attempt_number) AS k, CASE WHEN status IN ('timeout', 'unstable', 'failed') THEN 'bad' END AS sig FROM a),
        w AS (SELECT *, lag(sig) OVER o AS p1, lag(sig, 2) OVER o AS p2 FROM s WINDOW o AS (PARTITION BY entry ORDER BY k)), c AS (SELECT entry, min(k) AS cut FROM w WHERE sig = 'bad' AND p1 = 'bad' AND p2 = 'bad' GROUP BY entry)
        SELECT entry, 'bad' AS signature, cut AS processed, n - cut AS not_processed FROM c JOIN (SELECT entry, count(*) AS n FROM s GROUP BY entry) USING (entry)""",
    "read_outliers": f"{_with(READS)} SELECT id, grp AS \"group\", rate, ['none', 'low', 'high'][greatest(g, s) + 1] AS confidence, CASE WHEN greatest(g, s) > 0 THEN concat_ws(',', CASE WHEN g > 0 THEN 'slow_in_group' END, CASE WHEN s > 0 THEN 'stalled' END) END AS reason FROM x",
    "layout_gaps": """WITH p AS (SELECT l_orderkey AS disk, CAST(l_linenumber * 60 AS BIGINT) AS off, CAST(trunc(max(l_quantity)) AS BIGINT) AS size FROM lineitem GROUP BY ALL), d AS (SELECT o_orderkey AS disk FROM orders),
        c AS (SELECT disk, off, coalesce(max(off + size) OVER (PARTITION BY disk ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor FROM p), e AS (SELECT d.disk, coalesce(max(off + size), 0) AS last FROM d LEFT JOIN p USING (disk) GROUP BY d.disk)
        SELECT disk, CASE WHEN cursor = 0 THEN 'leading' ELSE 'inter_partition' END AS kind, cursor AS "offset", off - cursor AS size FROM c JOIN d USING (disk) WHERE off > cursor UNION ALL SELECT disk, 'trailing', last, 500 - last FROM e WHERE last < 500""",
    "stratified_sample": f"""{_with(FILES)}, o AS (SELECT entry, size, row_number() OVER (ORDER BY size, entry) AS place, count(*) OVER () AS n FROM files), k AS (SELECT *, least(n, greatest(50, ceil(n * 10 / 100.0)))::BIGINT AS k FROM o),
        st AS (SELECT *, (place > round_even(n / 4, 0))::INT + (place > round_even(2 * n / 4, 0))::INT + (place > round_even(3 * n / 4, 0))::INT AS s, sha256('{SEED}‖' || CAST(entry AS VARCHAR)) AS draw FROM k),
        t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY draw, entry) AS turn FROM st), z AS (SELECT *, row_number() OVER (ORDER BY (turn > k // 4 + (s < k % 4)::INT)::INT, draw, entry) AS final FROM t) SELECT entry, size FROM z WHERE final <= k""",
    "reconcile": f"""{_with(SIDES)} SELECT coalesce(n.root, o.root) AS root_label, coalesce(n.path, o.path) AS rel_path, coalesce(n.size, o.size) AS size, CAST(coalesce(n.mtime, o.mtime) AS BIGINT) AS mtime, CASE WHEN n.path IS NULL OR (n.size = o.size AND n.mtime = o.mtime) THEN 'done' ELSE 'pending' END AS meta_status,
        CASE WHEN n.path IS NULL OR (n.size = o.size AND n.mtime = o.mtime) THEN 'done' ELSE 'pending' END AS hash_status, CASE WHEN o.path IS NULL THEN 'inserted' WHEN n.path IS NULL THEN 'removed' WHEN n.size = o.size AND n.mtime = o.mtime THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.root = n.root AND o.path = n.path""",
    "reuse_plan": f"""{_with(SIDES)}, b AS (SELECT n.root AS root_label, n.path AS path_key, o.hash, CASE WHEN o.path IS NULL THEN 'no_previous_entry' WHEN n.size <> o.size OR n.mtime <> o.mtime THEN 'stat_changed' WHEN n.size % 7 = 0 OR o.size % 7 = 0 THEN 'placeholder' ELSE 'size+mtime+fileid' END AS basis
        FROM n LEFT JOIN o ON o.root = n.root AND o.path = n.path) SELECT root_label, path_key, starts_with(basis, 'size+') AS reuse, basis, CASE WHEN starts_with(basis, 'size+') THEN hash END AS hash_hex FROM b""",
    "rescan": f"""{_with(SIDES)} SELECT o.root AS root_label, o.path AS rel_path, CASE WHEN n.path IS NULL THEN 'gone' ELSE 'changed' END AS why, 'unstable' AS meta_status, 'unstable' AS hash_status FROM o LEFT JOIN n ON o.root = n.root AND o.path = n.path WHERE n.path IS NULL OR n.size <> o.size OR n.mtime <> o.mtime""",
    "stat_check": f"""{_with(SIDES)} SELECT o.root AS root_label, o.path AS rel_path, o.size, CAST(o.mtime AS BIGINT) AS mtime, n.size AS now_size, CAST(n.mtime AS BIGINT) AS now_mtime, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.size = o.size AND n.mtime = o.mtime THEN 'matched' ELSE 'changed' END AS status FROM o LEFT JOIN n ON o.root = n.root AND o.path = n.path""",
    "hash_check": f"""{_with(SIDES)} SELECT o.root AS root_label, o.path AS rel_path, o.hash AS expected, n.hash AS found, CASE WHEN n.path IS NULL THEN 'missing' WHEN n.unstable THEN 'unstable' WHEN n.hash IS NULL THEN 'tool_error' WHEN n.hash = o.hash THEN 'matched' ELSE 'mismatched' END AS status FROM o LEFT JOIN n ON o.root = n.root AND o.path = n.path""",
    "patrol": f"""{_with(SIDES)}, j AS (SELECT n.path IS NULL AS missing, n.path IS NOT NULL AND (n.size <> o.size OR n.mtime <> o.mtime) AS changed, o.hash AS a, n.hash AS b FROM o LEFT JOIN n ON o.root = n.root AND o.path = n.path),
        c AS (SELECT count(*) FILTER (missing) AS missing, count(*) FILTER (changed) AS changed, count(*) FILTER (NOT missing AND NOT changed AND a = b) AS matched, count(*) FILTER (NOT missing AND NOT changed AND (b IS NULL OR a <> b)) AS hash_problems, CAST(0 AS BIGINT) AS unverifiable FROM j) SELECT *, missing = 0 AND changed = 0 AND hash_problems = 0 AS ok FROM c""",
    "problem_counts": f"{_with(ATTEMPTS)} SELECT status, CAST(sum(CASE WHEN attempt_number % 5 = 0 THEN 3 ELSE 1 END) AS BIGINT) AS n FROM a WHERE status <> 'succeeded' GROUP BY status",
    "tool_failure_groups": f"{_with(ATTEMPTS)} SELECT error_code AS signature, count(*) AS affected FROM a WHERE error_code IS NOT NULL GROUP BY ALL",
    "metadata_issues": f"""{_with(FILES, DIAGNOSTICS)}, per AS (SELECT entry, count(*) FILTER (class = 'need_action') AS actions, count(*) FILTER (class = 'candidate') AS candidates, count(*) FILTER (class IN ('warning', 'minor')) AS warnings, count(*) FILTER (class = 'validation') AS validations, count(*) FILTER (class = 'unsupported') AS unsupported,
        count(DISTINCT family) AS families, arg_min(message, list_position(['need_action', 'candidate', 'validation', 'warning', 'minor', 'information', 'unsupported'], class) * 1000000000000 - diagnostic_pk) AS message FROM cl GROUP BY entry),
        b AS (SELECT files.entry, meta_status, coalesce(actions, 0) AS actions, coalesce(candidates, 0) AS candidates, coalesce(warnings, 0) AS warnings, coalesce(validations, 0) AS validations, coalesce(unsupported, 0) AS unsupported, coalesce(families, 0) AS families, message FROM files LEFT JOIN per USING (entry)),
        v AS (SELECT *, CASE WHEN actions > 0 OR (meta_status IN ('error', 'timeout', 'unstable') AND NOT (unsupported > 0 AND actions + candidates + warnings + validations = 0)) THEN 'need_action' WHEN candidates > 0 OR warnings >= 100 THEN 'candidate' WHEN validations > 0 THEN 'information' END AS level FROM b) SELECT * FROM v WHERE level IS NOT NULL""",
    "hash_issues": f"""{_with(FILES, ATTEMPTS, DIAGNOSTICS)}, u AS (SELECT entry, 1 AS s, 0 AS e, 0 AS t FROM files WHERE hash_status IN ('error', 'unstable') UNION ALL SELECT entry, 0, count(*), 0 FROM dg WHERE entry % 3 = 0 GROUP BY entry UNION ALL SELECT entry, 0, 0, 1 FROM last WHERE stage = 'hash' AND status IN ('failed', 'timeout', 'unstable', 'tool_error', 'invalid')),
        p AS (SELECT entry, max(s) AS s, sum(e) AS e, sum(t) AS t FROM u GROUP BY entry) SELECT count(*) AS affected, CAST(coalesce(sum(e + t + CASE WHEN s = 1 AND e + t = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS records FROM p""",
    "diagnostic_rollup": f"{_with(DIAGNOSTICS)} SELECT severity, diagnostic_code, 'f' AS field_name, count(*) AS n FROM cl WHERE class <> 'unsupported' GROUP BY ALL",
    "issue_flags": f"{_with(ATTEMPTS)} SELECT count(*) FILTER (error_code LIKE 'tool@_%' ESCAPE '@') AS tool_issues, count(*) FILTER (status = 'timeout') AS timeout_issues, count(*) FILTER (status IN ('failed', 'unstable', 'invalid') AND NOT coalesce(error_code, '') LIKE 'tool@_%' ESCAPE '@') AS source_issues FROM last",
    "capped_details": f"{_with(FILES)}, x AS (SELECT root_label, rel_path, entry, row_number() OVER (PARTITION BY root_label ORDER BY entry) AS k, count(*) OVER (PARTITION BY root_label) AS total FROM files WHERE meta_status = 'error') SELECT root_label, rel_path, entry, total FROM x WHERE k <= 5",
    "payload_tags": """WITH t AS (SELECT event_id, lower(unnest(json_keys(props))) AS tag, unnest(json_keys(props)) AS k, props FROM events), v AS (SELECT event_id, tag, json_extract_string(props, '$.' || k) AS value FROM t)
        SELECT event_id, tag AS family, tag, value, CAST(NULL AS VARCHAR) AS number FROM v UNION ALL SELECT event_id, '*', tag, value, NULL FROM v""",
    "journal_rollup": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "run_history": """SELECT 'event' AS record_type, CAST(event_id AS VARCHAR) AS record_key, CAST(NULL AS VARCHAR) AS recorded_at, CAST(json_object('event_id', event_id, 'event_type', event_type) AS VARCHAR) AS payload FROM events
        UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), NULL, CAST(json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus) AS VARCHAR) FROM orders""",
    "business_projection": f"""{_with(SIDES)} SELECT 'entries' AS section, CAST(json_object('root_label', root, 'rel_path', path) AS VARCHAR) AS key, CAST(json_object('hash_hex', hash, 'size', size) AS VARCHAR) AS values FROM o
        UNION ALL SELECT 'dirs', CAST(json_object('root_label', root, 'rel_path', path) AS VARCHAR), CAST(json_object('enum_status', 'ok') AS VARCHAR) FROM od""",
    "capability_matrix": "SELECT 'documents' AS capability, 'available' AS state, count(*) AS n FROM documents UNION ALL SELECT 'pages', 'available', count(*) FROM pages UNION ALL SELECT 'events', 'available', count(*) FROM events UNION ALL SELECT 'labels', 'available', count(*) FROM labels UNION ALL SELECT 'lineitem', 'incompatible', NULL",
    "match_targets": """WITH d AS (SELECT c_custkey AS disk FROM customer), v AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN -o_custkey ELSE o_custkey END AS disk, min(CAST(o_orderkey AS VARCHAR)) AS device, count(*) > 1 AS several FROM orders GROUP BY ALL)
        SELECT coalesce(d.disk, v.disk) AS disk, device, CASE WHEN d.disk IS NULL THEN 'no_disk' WHEN device IS NULL THEN 'no_device' WHEN several THEN 'several_devices' ELSE 'matched' END AS status FROM d FULL JOIN v ON d.disk = v.disk""",
    "critical_smart": """WITH a AS (SELECT l_orderkey AS disk, CAST(l_linenumber + l_suppkey % 200 AS BIGINT) AS id, CASE WHEN l_returnflag = 'R' THEN 'now' END AS failed, CAST(trunc(l_quantity) AS BIGINT) AS raw FROM lineitem)
        SELECT disk, CAST(list_position([5, 10, 184, 187, 188, 196, 197, 198, 199, 200], id) AS BIGINT) AS place, id, raw, CASE WHEN failed IS NOT NULL THEN 'failed' WHEN id <> 200 AND raw > 0 THEN 'attention' ELSE 'ok' END AS status FROM a WHERE id IN (5, 10, 184, 187, 188, 196, 197, 198, 199, 200)""",
    "volume_usage": """WITH v AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS size, p_partkey % 40 AS size_remaining FROM part) SELECT p_partkey, 'C:' AS drive_letter, size, size_remaining, CASE WHEN size >= size_remaining THEN size - size_remaining END AS used_bytes,
        CASE WHEN size >= size_remaining THEN round_even((size - size_remaining) * 100.0::DOUBLE / nullif(size, 0), 4) END AS used_percent FROM v""",
    "constraint_violations": "SELECT * FROM (VALUES ('roots', 'enum_status', 0), ('roots', 'unique', 0), ('dirs', 'enum_status', 0), ('dirs', 'unique', 0), ('dirs', 'in roots', 0), ('entries', 'size', 0), ('entries', 'placeholder', 0), ('entries', 'path_key', 0), ('entries', 'unique', 0), ('entries', 'in roots', 0)) v(\"table\", rule, n) WHERE EXISTS (SELECT 1 FROM documents)",
}

_sums = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 12 * k}, 12) AS BIGINT)) AS VARCHAR)" for k in range(5))
ORACLE_SQL["business_digest"] = f"""WITH b AS ({ORACLE_SQL["business_projection"]}), h AS (SELECT section, sha256(key || chr(31) || "values") AS h FROM b), p AS (SELECT section, substr(h, 1, 3) AS part, count(*) AS n, concat_ws(',', {_sums}) AS sums FROM h GROUP BY ALL)
        SELECT section, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(part || ':' || n || ':' || sums, chr(10) ORDER BY part || ':' || n || ':' || sums)) AS digest FROM p GROUP BY section"""
