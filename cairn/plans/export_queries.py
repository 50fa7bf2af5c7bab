"""Exports of every module of a snapshot over the driver's tables, with their SQL.

Entries are documents (root: source, folder: language) or pages (root: web);
what the tools said of them is that of ``metadata_queries`` and ``record_queries``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import issues, metadata
from cairn.sources import bundle, files
from cairn.sources.storage import shared_dir, stored
from cairn.streaming import journal

from . import metadata_queries, projections, record_queries
from .bundle_queries import bundle_of, shaped
from .metadata_queries import ORACLE_SQL as METADATA_SQL
from .model import DIRS, SIDES, table
from .record_queries import ORACLE_SQL as RECORD_SQL

PAYLOADS = {"exiftool": "13.1", "ffprobe": "7"}


def doc_entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("entry"), F.col("source").alias("root_label"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"))


def page_entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(F.col("page_id").alias("entry"), F.lit("web").alias("root_label"), F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("rel_path"))


def recorded(s: SparkSession, d: str) -> DataFrame:
    """Recorded tool output of documents: both tools twice, the later one with the version in PAYLOADS."""
    tools = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(v).alias("provider_version"), F.lit(t).alias("parsed_at_utc")) for p, version in PAYLOADS.items() for v, t in ((version, "2024-02"), ("0", "2024-01"))]))
    return table(s, d, "documents").where("doc_id % 6 > 0").select(F.col("doc_id").alias("entry"), tools.alias("t")).select("entry", "t.*")


def module(name: str, rows: DataFrame, s: SparkSession, d: str) -> DataFrame:
    return projections.metadata_module(name, rows, doc_entries(s, d), recorded(s, d))


def export_archives(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    packed = table(s, d, "pages").select(k.cast("string").alias("path"), record_queries.zipped(F.concat(F.lit("m/"), k.cast("string")), F.coalesce("html", F.lit(""))).alias("content"))
    members = files.zip_members(packed).withColumn("entry", F.col("path").cast("bigint")).drop("crc32_hex", "packed_bytes", "attributes", "create_version", "host_os")
    totals = files.archive_totals(members.withColumn("packed_bytes", F.lit(None).cast("bigint"))).withColumn("entry", F.col("path").cast("bigint")).withColumn("archive_format", F.lit("zip"))
    return projections.archives(members, totals, page_entries(s, d))


def export_gps(s: SparkSession, d: str) -> DataFrame:
    return projections.metadata_module("video_gps", metadata.gps_points(metadata_queries.film_payloads(s, d)), page_entries(s, d))


def performance(s: SparkSession, d: str) -> DataFrame:
    """Events as reads of users' files: every third surely slow, every third perhaps."""
    e = F.col("event_id")
    made = table(s, d, "events").select(
        F.lit("r").alias("root_label"), F.concat(F.lit("f/"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("rel_path"), e.alias("attempt_id"), F.element_at(F.array(*map(F.lit, ("none", "low", "high"))), (e % 3 + 1).cast("int")).alias("candidate_confidence"), F.lit("slow").alias("candidate_reason"),
        (e * 1024).alias("bytes_read"), (e % 5).cast("double").alias("elapsed_seconds"), F.lit("hash").alias("stage"), F.col("event_type").alias("origin"),
    )
    return shaped(made, "read_performance")


def read_entries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.lit("r").alias("root_label"), F.concat(F.lit("f/"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("rel_path")).distinct().withColumn("path_key", F.col("rel_path"))


def slow_reads(s: SparkSession, d: str) -> DataFrame:
    return issues.slow_reads(performance(s, d), read_entries(s, d)).select("root_label", "rel_path", "attempt_id", "reason", "bytes_read", "elapsed_seconds", "mib_per_second", "stage", "origin", "total")


def execution_counts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    attempts = e.select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), F.col("event_id").alias("attempt_number"), F.col("event_type").alias("status"))
    return issues.execution_counts(e.select(F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("status")), attempts, performance(s, d))


def business_snapshot(s: SparkSession, d: str) -> DataFrame:
    """Rows, keys and one digest a section of a whole snapshot's business projection, with photos; payloads aren't available in it."""
    own = bundle_of(s, d, True)
    own["errors"] = shaped(own["entries"].where("size_bytes % 2 = 0").select("root_label", "rel_path", F.lit("hash").alias("stage"), F.lit("io_error").alias("error_code"), F.col("name").alias("message"), F.lit("later").alias("occurred_at_utc")), "errors")
    own["metadata_diagnostics"] = shaped(own["entries"].where("size_bytes % 3 = 0").select("root_label", "rel_path", F.lit("exiftool").alias("provider"), F.lit("warning").alias("severity"), F.lit("c").alias("diagnostic_code"), F.lit("f").alias("field_name")), "metadata_diagnostics")
    capability = bundle.capabilities(s, own | {"raw_payloads": None, "photo_metadata": own["entries"]}, {name: [] for name in (*projections.BUSINESS, "photo_metadata")})
    photos = module("photo_metadata", metadata.photo(metadata_queries.tagged(s, d)), s, d)
    found = projections.business_sections(own, capability, {"photo_metadata": photos})
    volatile = F.col("values").contains("observed_at_utc") | F.col("values").contains("occurred_at_utc") | F.col("values").contains("_pk")
    return found.groupBy("section").agg(F.count("*").alias("rows"), F.countDistinct("key").alias("keys"), F.count_if(volatile).alias("volatile"))


def journal_ingest(s: SparkSession, d: str) -> DataFrame:
    """Events as journal files that come in two parts, ingested by a stream that is stopped in between: events by name, and lines that are none."""
    base = f"{shared_dir(s)}/journal-{uuid.uuid4().hex}"
    e = F.col("event_id")
    line = F.when(e % 50 == 0, F.concat(F.lit('{"eve'), e.cast("string"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("event"), e.alias("id"))))
    for part in (0, 1):
        table(s, d, "events").where(e % 2 == part).select(line.alias("value")).write.mode("append").text(f"{base}/in")
        journal.journal_stream(s, f"{base}/in", f"{base}/good", f"{base}/bad", f"{base}/checkpoint").awaitTermination()
    good, bad = s.read.schema("value string, event string").parquet(f"{base}/good"), s.read.schema("value string").parquet(f"{base}/bad")
    return good.groupBy("event").agg(F.count("*").alias("n"), F.countDistinct("value").alias("lines")).unionByName(bad.agg(F.lit(None).cast("string").alias("event"), F.count("*").alias("n"), F.countDistinct("value").alias("lines")))


def attempt_fates(s: SparkSession, d: str) -> DataFrame:
    """What became of attempts that events stand for, by a stream with state that is stopped in between and goes on with the later half."""
    base = f"{shared_dir(s)}/fates-{uuid.uuid4().hex}"
    e, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    events = table(s, d, "events").select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), e.alias("attempt_number"), ts.alias("ts"))
    ends = events.where("attempt_number % 3 > 0").withColumn("ts", F.timestamp_add("MINUTE", F.col("attempt_number") % 5 * 20, F.col("ts")))
    rows = events.withColumn("status", F.lit("running")).unionByName(ends.withColumn("status", F.lit("succeeded"))).select("entry", "stage", "attempt_number", "status", "ts")
    middle = rows.agg(F.timestamp_seconds((F.unix_timestamp(F.min("ts")) + F.unix_timestamp(F.max("ts"))) / 2).alias("m"))  # one row
    halves = stored(rows.join(F.broadcast(middle), F.lit(True)).withColumn("late", F.col("ts") > F.col("m")).drop("m"), "attempts")
    for late in (False, True):
        halves.where(F.col("late") == late).drop("late").write.mode("append").parquet(f"{base}/in")
        told = journal.attempt_fates(s.readStream.schema("entry bigint, stage string, attempt_number bigint, status string, ts timestamp").parquet(f"{base}/in"))
        told.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = s.read.schema(journal.FATE).parquet(f"{base}/out")
    return found.groupBy("fate").agg(F.count("*").alias("n"), F.countDistinct("attempt_number").alias("attempts"), F.sum("entry").alias("entries"))


QUERIES = {
    "journal_ingest": journal_ingest,
    "attempt_fates": attempt_fates,
    "export_hashes": lambda s, d: projections.project("hashes", bundle_of(s, d, True)["hashes"]),
    "export_photo_metadata": lambda s, d: module("photo_metadata", metadata.photo(metadata_queries.tagged(s, d)), s, d),
    "export_video_metadata": lambda s, d: module("video_metadata", record_queries.film_metadata(s, d), s, d),
    "export_video_gps": export_gps,
    "export_working_metadata": lambda s, d: module("working_metadata", record_queries.working_rows(s, d), s, d),
    "export_document_metadata": lambda s, d: module("document_metadata", record_queries.document_rows(s, d), s, d),
    "export_archives": export_archives,
    "slow_reads": slow_reads,
    "slow_read_counts": lambda s, d: issues.slow_read_counts(performance(s, d)),
    "execution_counts": execution_counts,
    "business_snapshot": business_snapshot,
}


def _export(module_name: str, rows: str, known: str, provider: str | None = None) -> str:
    """SQL of a module's export: rows is SQL with entry; fields that ``known`` doesn't list are null."""
    given = known.split(" ")
    told = {"parser": f"CASE WHEN doc_id % 6 > 0 THEN '{provider}' END", "parser_version": f"CASE WHEN doc_id % 6 > 0 THEN '{PAYLOADS.get(provider)}' END", "parsed_at_utc": "CASE WHEN doc_id % 6 > 0 THEN '2024-02' END"} if provider else {}
    fields = ", ".join(f"{f if f in given else told.get(f, 'NULL')} AS {f}" for f in projections.FIELDS[module_name])
    return f"WITH x AS ({rows}) SELECT source AS root_label, lang || '/' || doc_id AS rel_path, source || chr(92) || lang || '/' || doc_id AS logical_path, {fields} FROM x JOIN documents ON doc_id = entry"


_reused = "doc_id % 2 = 0"
_hash_known = {"algorithm": "'sha256'", "hash_hex": "hash", "origin": f"CASE WHEN {_reused} THEN 'reused' ELSE 'computed' END", "source_snapshot_uuid": f"CASE WHEN {_reused} THEN 'old' END", "source_computed_at_utc": f"CASE WHEN {_reused} THEN CAST(doc_id AS VARCHAR) END", "finished_at_utc": f"CASE WHEN NOT {_reused} THEN CAST(doc_id AS VARCHAR) END", "status": "'valid'"}
_hash_fields = ", ".join(f"{_hash_known.get(f, 'NULL')} AS {f}" for f in projections.FIELDS["hashes"])
_photo = METADATA_SQL["photo_metadata"].replace(" FROM documents", ", 'ExifIFD:DateTimeOriginal' || CASE WHEN doc_id % 3 = 0 THEN '|offset=ExifIFD:OffsetTimeOriginal' ELSE '' END AS capture_time_source FROM documents")

ORACLE_SQL = {
    "journal_ingest": """SELECT event_type AS event, count(*) AS n, count(*) AS lines FROM events WHERE event_id % 50 > 0 GROUP BY ALL UNION ALL SELECT NULL, count(*), count(*) FROM events WHERE event_id % 50 = 0""",
    "attempt_fates": """WITH a AS (SELECT user_id, event_id, CAST(ts AS TIMESTAMP) AS s, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS TIMESTAMP) + to_minutes(CAST(event_id % 5 * 20 AS INTEGER)) END AS e FROM events), m AS (SELECT greatest(max(s), max(e)) - INTERVAL 10 MINUTE AS mark FROM a)
        SELECT CASE WHEN e <= s + INTERVAL 1 HOUR THEN 'succeeded' ELSE 'abandoned' END AS fate, count(*) AS n, count(*) AS attempts, CAST(sum(user_id) AS BIGINT) AS entries FROM a, m WHERE least(coalesce(e, s + INTERVAL 1 HOUR), s + INTERVAL 1 HOUR) < mark GROUP BY ALL""",
    "export_hashes": f"WITH {SIDES.strip()} SELECT root AS root_label, path AS rel_path, root || chr(92) || path AS logical_path, {_hash_fields} FROM n WHERE hash IS NOT NULL",
    "export_photo_metadata": _export("photo_metadata", _photo, "capture_time_raw capture_time_source capture_tz_offset_min capture_time_utc camera_make camera_model lens_serial width iso f_number focal_length_mm gps_latitude", "exiftool"),
    "export_video_metadata": _export("video_metadata", RECORD_SQL["film_metadata"].replace(" FROM documents", ", 0 AS capture_tz_offset_min FROM documents"), "container_format duration_seconds bit_rate stream_count timecode capture_time_raw capture_time_source capture_tz_offset_min capture_time_utc camera_make camera_model title author", "ffprobe"),
    "export_video_gps": f"WITH x AS ({METADATA_SQL['gps_points']}) SELECT 'web' AS root_label, 'p/' || entry AS rel_path, 'web' || chr(92) || 'p/' || entry AS logical_path, point_index, CAST(NULL AS DOUBLE) AS timestamp_seconds, gps_latitude, gps_longitude, gps_altitude, NULL AS source, raw_value FROM x",
    "export_working_metadata": _export("working_metadata", RECORD_SQL["working_metadata"], "file_variant creator_app color_mode bit_depth width height layer_count layer_names has_thumbnail", "exiftool"),
    "export_document_metadata": _export("document_metadata", RECORD_SQL["document_metadata"], "doc_format title author last_modified_by creator_app created_prop_raw modified_prop_raw page_count is_encrypted", "exiftool"),
    "export_archives": """WITH p AS (SELECT page_id, 'web' AS root_label, 'p/' || page_id AS rel_path, 'web' || chr(92) || 'p/' || page_id AS logical_path, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages)
        SELECT 'archive' AS record_type, root_label, rel_path, logical_path, 'zip' AS archive_format, 1 AS member_count, n AS uncompressed_bytes, 0 AS compressed_bytes, 0 AS has_encrypted, NULL AS member_index, NULL AS member_path, NULL AS is_dir, NULL AS size_bytes, NULL AS method, NULL AS flag_bits, NULL AS encrypted, NULL AS extract_version, NULL AS header_offset, NULL AS modified_raw FROM p
        UNION ALL SELECT 'member', root_label, rel_path, logical_path, NULL, NULL, NULL, NULL, NULL, 0, 'm/' || page_id, 0, n, 'deflate', 0, 0, 20, 0, '2024-03-05 06:07:08' FROM p""",
    "slow_reads": """WITH p AS (SELECT 'r' AS root_label, 'f/' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS rel_path, event_id, event_type FROM events WHERE event_id % 3 = 2)
        SELECT root_label, rel_path, event_id AS attempt_id, 'slow' AS reason, event_id * 1024 AS bytes_read, (event_id % 5)::DOUBLE AS elapsed_seconds, CASE WHEN event_id % 5 > 0 THEN round_even((event_id * 1024)::DOUBLE / (event_id % 5)::DOUBLE / 1048576.0::DOUBLE, 3) END AS mib_per_second, 'hash' AS stage, event_type AS origin, (SELECT count(*) FROM p) AS total
        FROM p ORDER BY root_label, rel_path, event_id LIMIT 200""",
    "slow_read_counts": "SELECT count(DISTINCT user_id) FILTER (event_id % 3 = 2) AS issue_files, count(*) FILTER (event_id % 3 = 2) AS issue_records, count(DISTINCT user_id) FILTER (event_id % 3 = 1) AS low_confidence_files, count(*) FILTER (event_id % 3 = 1) AS low_confidence_records FROM events",
    "execution_counts": """SELECT 'format_status' AS section, 's' || event_id % 4 AS key, count(*) AS value FROM events GROUP BY ALL UNION ALL SELECT 'performance_confidence', ['none', 'low', 'high'][event_id % 3 + 1], count(*) FROM events GROUP BY ALL
        UNION ALL SELECT 'latest_attempt', 'hash.' || event_type, count(*) FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) GROUP BY ALL""",
    "business_snapshot": f"""WITH {SIDES.strip()}, {DIRS.strip()}, c AS (SELECT 'capabilities' AS section, 8 AS rows, 8 AS keys UNION ALL SELECT 'profile', 1, 1 UNION ALL SELECT 'roots', count(DISTINCT root), count(DISTINCT root) FROM n UNION ALL SELECT 'dirs', count(*), count(*) FROM nd UNION ALL SELECT 'entries', count(*), count(*) FROM n
        UNION ALL SELECT 'hashes', count(*), count(*) FROM n WHERE hash IS NOT NULL UNION ALL SELECT 'errors', count(*), count(*) FROM n WHERE size % 2 = 0 UNION ALL SELECT 'metadata_diagnostics', count(*), count(*) FROM n WHERE size % 3 = 0 UNION ALL SELECT 'photo_metadata', count(*), count(*) FROM documents)
        SELECT section, CAST(rows AS BIGINT) AS rows, CAST(keys AS BIGINT) AS keys, CAST(0 AS BIGINT) AS volatile FROM c WHERE rows > 0""",
}
