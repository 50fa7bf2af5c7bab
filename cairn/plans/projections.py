"""Exports of a snapshot: fixed field lists, joined by logical keys, and their files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cairn.functions.payload import value_type
from cairn.functions.text import compat_mode, logical_path, parent_path
from cairn.sources.files import file_digests

KEY = ["root_label", "rel_path"]

# Fields of the exports after root_label, rel_path and logical_path.
FIELDS = {
    "files": ["name", "extension", "media_kind", "size_bytes", "created_at_utc", "modified_at_utc", "attributes", "is_placeholder", "hard_link_count", "volume_serial", "file_index_hex", "observed_at_utc", "meta_status", "hash_status"],
    "directories": ["parent_rel_path", "enum_status", "error_message", "file_count", "subdir_count", "attributes", "observed_at_utc"],
    "hashes": ["algorithm", "hash_hex", "origin", "source_snapshot_uuid", "source_computed_at_utc", "reuse_basis", "size_bytes", "bytes_read", "chunk_bytes", "started_at_utc", "finished_at_utc", "pre_size", "pre_mtime_utc", "post_size", "post_mtime_utc", "status", "failure_reason", "tool", "tool_version"],
    "photo_metadata": ["capture_time_raw", "capture_time_source", "capture_tz_offset_min", "capture_time_utc", "camera_make", "camera_model", "camera_serial", "lens_model", "lens_serial", "width", "height", "orientation", "iso", "f_number", "exposure_time", "exposure_compensation", "focal_length_mm", "focal_length_35mm", "white_balance", "color_temperature", "color_space", "icc_profile", "software", "bit_depth", "gps_latitude", "gps_longitude", "gps_altitude", "parser", "parser_version", "parsed_at_utc"],
    "video_metadata": ["container_format", "duration_seconds", "bit_rate", "stream_count", "timecode", "capture_time_raw", "capture_time_source", "capture_tz_offset_min", "capture_time_utc", "camera_make", "camera_model", "camera_serial", "lens_model", "lens_serial", "iso", "white_balance", "shutter", "gamma", "color_gamut", "encoder", "title", "author", "album", "copyright", "parser", "parser_version", "parsed_at_utc"],
    "video_gps": ["point_index", "timestamp_seconds", "gps_latitude", "gps_longitude", "gps_altitude", "source", "raw_value"],
    "working_metadata": ["file_variant", "creator_app", "color_mode", "bit_depth", "width", "height", "layer_count", "layer_names", "has_thumbnail", "parser", "parser_version", "parsed_at_utc"],
    "document_metadata": ["doc_format", "title", "author", "last_modified_by", "creator_app", "created_prop_raw", "modified_prop_raw", "page_count", "is_encrypted", "parser", "parser_version", "parsed_at_utc"],
}
#: Fields that a source may not know: they are null then.
UNKNOWN = {"iso": "bigint", "white_balance": "string", "shutter": "string", "gamma": "string", "color_gamut": "string", "timestamp_seconds": "double", "source": "string", "parser": "string", "parser_version": "string", "parsed_at_utc": "string"}
#: Providers whose payloads a module's rows come from.
PROVIDERS = {"photo_metadata": "exiftool", "working_metadata": "exiftool", "document_metadata": "exiftool", "video_metadata": "ffprobe"}


def project(module: str, rows: DataFrame) -> DataFrame:
    """The fields of a module; a field that the rows lack is an error."""
    fields = FIELDS[module]
    if missing := [f for f in fields if f not in rows.columns]:
        raise ValueError(f"{module} lacks {missing}")
    return rows.select(*KEY, logical_path(F.col("root_label"), F.col("rel_path")).alias("logical_path"), *fields)


def directories(dirs: DataFrame) -> DataFrame:
    """Directories with the path of the one above: told by the path, without a self-join."""
    return project("directories", dirs.withColumn("parent_rel_path", parent_path(F.col("rel_path"))))


def file_manifest(entries: DataFrame, hashes: DataFrame) -> DataFrame:
    """Every file with its SHA-256, if it has a valid one."""
    sha = hashes.where("algorithm = 'sha256' and status = 'valid'").select(*KEY, "hash_hex")
    return entries.join(sha, KEY, "left").select(*KEY, logical_path(F.col("root_label"), F.col("rel_path")).alias("logical_path"), "size_bytes", "modified_at_utc", "hash_hex")


def dir_problems(dirs: DataFrame) -> DataFrame:
    return dirs.where("enum_status <> 'ok'")


def metadata_module(module: str, rows: DataFrame, entries: DataFrame, payloads: DataFrame | None = None) -> DataFrame:
    """The export of a module from what ``metadata`` gives (entry and fields).

    entries: entry, root_label, rel_path. payloads: entry, provider,
    provider_version and parsed_at_utc of the recorded tool output, which tell the
    parser; without them it is unknown. Fields that no source knows are null.
    """
    if payloads is not None and module in PROVIDERS:
        told = payloads.where(F.col("provider") == PROVIDERS[module]).groupBy("entry").agg(F.max_by(F.struct(F.col("provider").alias("parser"), F.col("provider_version").alias("parser_version"), "parsed_at_utc"), "parsed_at_utc").alias("_p"))
        rows = rows.join(told, "entry", "left").select(*rows.columns, "_p.*")
    absent = {f: F.lit(None).cast(UNKNOWN[f]) for f in FIELDS[module] if f not in rows.columns and f in UNKNOWN}
    return project(module, rows.withColumns(absent).join(entries.select("entry", *KEY), "entry"))


#: Columns of an export of archives: those of an archive, then those of a member.
ARCHIVE_FIELDS = ["archive_format", "member_count", "uncompressed_bytes", "compressed_bytes", "has_encrypted"]


def archives(members: DataFrame, totals: DataFrame, entries: DataFrame) -> DataFrame:
    """Archives and their members in one shape (record_type). members: entry and what ``files.zip_members`` tells; totals: entry, archive_format and what ``files.archive_totals`` counts."""
    of = lambda df: df.join(entries.select("entry", *KEY), "entry").withColumn("logical_path", logical_path(F.col("root_label"), F.col("rel_path")))
    shown = [c for c in members.columns if c not in ("entry", "path")]
    return union_shaped({"archive": of(totals).select(*KEY, "logical_path", *ARCHIVE_FIELDS), "member": of(members).select(*KEY, "logical_path", *shown)})


def union_shaped(parts: dict[str, DataFrame], kind: str = "record_type") -> DataFrame:
    """Rows of several tables in one shape; what a table lacks is null (streams, archives and members, errors and diagnostics)."""
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias(kind), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def run_history(tables: dict[str, tuple[DataFrame, list[str], str | None]]) -> DataFrame:
    """record_type, record_key, recorded_at and payload (JSON) of runtime tables: name to (rows, key columns, time column)."""
    parts = None
    for name, (df, keys, time) in tables.items():
        shaped = df.select(F.lit(name).alias("record_type"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("record_key"), (F.col(time).cast("string") if time else F.lit(None).cast("string")).alias("recorded_at"), F.to_json(F.struct(*df.columns)).alias("payload"))
        parts = shaped if parts is None else parts.unionByName(shaped)
    return parts


def error_paths(errors: DataFrame, entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """Errors with the logical path of the entry or directory that they are about; the path may be null."""
    of = lambda df, k: df.select(F.col(k), logical_path(F.col("root_label"), F.col("rel_path")).alias(f"{k}_path"))
    return errors.join(of(entries, "entry"), "entry", "left").join(of(dirs, "dir"), "dir", "left").select("error_pk", "stage", "error_code", "message", F.coalesce("entry_path", "dir_path").alias("logical_path"))


def overview(identity: DataFrame, counts: DataFrame) -> DataFrame:
    """section, key, value and value_type: one row of identity, and counts by section and key."""
    own = identity.select(F.explode(F.map_entries(F.from_json(F.to_json(F.struct(*identity.columns)), "map<string,variant>"))).alias("e"))
    own = own.select(F.lit("identity").alias("section"), F.col("e.key").alias("key"), F.try_variant_get("e.value", "$", "string").alias("value"), value_type(F.col("e.value")).alias("value_type"))
    return own.unionByName(counts.select("section", "key", F.col("value").cast("string").alias("value"), F.lit("integer").alias("value_type")))


def business_projection(tables: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """section, key and values (JSON) of each table: name to (rows, key columns, columns that don't count, such as ids and times of observation)."""
    out = None
    for name, (df, keys, volatile) in tables.items():
        values = sorted(c for c in df.columns if c not in keys and c not in volatile)
        shaped = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*keys)).alias("key"), F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("values"))
        out = shaped if out is None else out.unionByName(shaped)
    return out


#: Tables of a bundle in a business projection: keys, and what is observation or numbering and doesn't count.
BUSINESS = {
    "roots": (["root_label"], []),
    "dirs": (KEY, ["observed_at_utc"]),
    "entries": (KEY, ["observed_at_utc"]),
    "hashes": ([*KEY, "algorithm"], ["started_at_utc", "finished_at_utc"]),
    "raw_payloads": ([*KEY, "provider"], ["payload_zlib", "parsed_at_utc"]),
    "metadata_diagnostics": ([*KEY, "provider", "diagnostic_code", "field_name"], ["diagnostic_pk", "observed_at_utc"]),
    "errors": (KEY, ["error_pk", "occurred_at_utc", "is_dir"]),
}


def business_sections(bundle: dict[str, DataFrame], capability: DataFrame, metadata: dict[str, DataFrame] | None = None) -> DataFrame:
    """The business projection of a whole snapshot: capabilities, profile, roots, folders with the folder above, entries, hashes, payloads, diagnostics, errors, and metadata exports.

    capability: capability and state; what isn't available or empty has no rows. metadata: exports by module.
    """
    tables = {"capabilities": (capability.select("capability", "state"), ["capability"], [])}
    info = bundle["snapshot_info"]
    tables["profile"] = (info.select("hash_coverage", "path_key_rule", "schema_version", F.lit("profile").alias("name")), ["name"], [])
    for name, (keys, volatile) in BUSINESS.items():
        if name in bundle:
            df = bundle[name]
            tables[name] = (df.withColumn("parent_rel_path", parent_path(F.col("rel_path"))) if name == "dirs" else df, keys, volatile)
    for name, df in (metadata or {}).items():
        tables[name] = (df, KEY, ["logical_path", "parsed_at_utc"])
    known = {r.capability for r in capability.where("state not in ('available', 'empty')").select("capability").collect()}  # a few dozen
    return business_projection({name: t for name, t in tables.items() if name not in known})


def business_digest(projection: DataFrame) -> DataFrame:
    """section, rows and a digest that doesn't depend on their order: sums of row digests by part, then over the parts.

    A row's digest is SHA-256; parts are its first three hex digits, so no task
    gathers more than a small share of a section and the last step sees 4096 texts.
    """
    each = projection.select("section", F.sha2(F.concat_ws("\x1f", "key", "values").cast("binary"), 256).alias("h")).withColumn("part", F.substring("h", 1, 3))
    words = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(5)]
    parts = each.groupBy("section", "part").agg(F.count("*").alias("n"), F.concat_ws(",", *words).alias("sums"))
    return parts.groupBy("section").agg(F.sum("n").alias("rows"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "n", "sums"))), "\n").cast("binary"), 256).alias("digest"))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("lineSep", "\n").option("encoding", "UTF-8").mode("errorifexists").csv(path)


def export_jsonl(df: DataFrame, path: str, contract: str, database: str, module: str) -> None:
    """One JSON object a line: contract, database, module_id and the record."""
    envelope = F.to_json(F.struct(F.lit(contract).alias("contract"), F.lit(database).alias("database"), F.lit(module).alias("module_id"), F.struct(*df.columns).alias("record")), {"ignoreNullFields": "false"})
    df.select(envelope.alias("value")).write.mode("errorifexists").text(path)


def export_manifest(df: DataFrame, path: str) -> DataFrame:
    """A row for every file of an export, with its size and SHA-256."""
    return file_digests(df.sparkSession, path, "part-*").select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def export_module(df: DataFrame, path: str, module: str, kind: str = "csv", identity: str | None = None, warnings: list[str] | None = None, contract: str = "", database: str = "") -> DataFrame:
    """Write a module's rows as csv or jsonl and return one row on it: fields, rows, the input's identity, files with digests, and warnings.

    Rows are counted and their digests added up while they are written, so the
    rows are worked out once; ``identity`` is the caller's name for the input, such as a
    bundle's fingerprint. The digest of rows doesn't depend on their order.
    """
    seen = Observation(f"export-{uuid.uuid4().hex}")
    digest = F.xxhash64(*df.columns) if df.columns else F.lit(0).cast("long")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(digest), F.lit(0)).alias("x"), F.coalesce(F.sum(F.shiftrightunsigned(digest, 32)), F.lit(0)).alias("s"))
    if kind == "csv":
        export_csv(counted, path)
    else:
        export_jsonl(counted, path, contract, database, module)
    told = seen.get
    row = df.sparkSession.createDataFrame([(module, df.columns, told["rows"], f"{told['rows']:x}-{told['x'] & (1 << 64) - 1:016x}-{told['s']:x}", identity, warnings or [])], "module_id string, fields array<string>, rows bigint, rows_digest string, input_identity string, warnings array<string>")
    # A digest of the files' own, put together in parts; their list lies beside the export.
    files = export_manifest(df, path)
    files.write.mode("errorifexists").parquet(f"{path.rstrip('/')}.files")
    listed = df.sparkSession.read.schema("file string, bytes bigint, sha256 string").parquet(f"{path.rstrip('/')}.files")
    whole = listed.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.substring("file", 1, 10), "sha256"))), "\n"), 256).alias("files_digest"))  # a file a task
    return row.join(whole, F.lit(True))


def module_manifest(df: DataFrame, path: str, module: str, warnings: list[str] | None = None) -> DataFrame:
    """One row on an exported module: its fields, rows, files with digests, and warnings."""
    files = export_manifest(df, path).agg(F.array_sort(F.collect_list(F.struct("file", "bytes", "sha256"))).alias("artifacts"))  # files of one module's export
    return files.join(df.agg(F.count("*").alias("rows")), F.lit(True)).select(F.lit(module).alias("module_id"), F.array(*map(F.lit, df.columns)).alias("fields"), "rows", "artifacts", F.array(*map(F.lit, warnings or [])).cast("array<string>").alias("warnings"))


def preview(df: DataFrame, n: int = 200) -> DataFrame:
    """The first rows for people to look at, control characters escaped."""
    texts = [F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "�").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.select(*texts).limit(n)


def path_of(label: str, rel_path: str):
    """The logical path of one side of a comparison; null without a path."""
    return F.when(F.col(rel_path).isNotNull(), logical_path(F.col(label), F.col(rel_path)))


def file_changes(entries: DataFrame) -> DataFrame:
    """The files of a comparison with logical paths and the content group that decided them."""
    return entries.select(
        "path_key", "old_root", "new_root", "old_path", "new_path", path_of("old_root", "old_path").alias("old_logical_path"), path_of("new_root", "new_path").alias("new_logical_path"), "status", "evidence", "reason",
        "old_size", "new_size", "old_mtime", "new_mtime", "old_hash", "new_hash", "old_origin", "new_origin", "metadata_changed", "group_hash",
    )


def directory_changes(dirs: DataFrame) -> DataFrame:
    return dirs.select("path_key", "old_root", "new_root", "old_path", "new_path", path_of("old_root", "old_path").alias("old_logical_path"), path_of("new_root", "new_path").alias("new_logical_path"), "status", "old_enum", "new_enum", "reason")


def gap_rows(subtrees: DataFrame) -> DataFrame:
    return subtrees.select("side", "root_label", "rel_path", logical_path(F.col("root_label"), F.col("rel_path")).alias("logical_path"), "enum_status", "affected_estimate")


def diff_overview(info: DataFrame, entries: DataFrame) -> DataFrame:
    """section, key, value and value_type of a comparison: one row of identity, counts by status, and whether both sides have one structure version."""
    counts = entries.groupBy(F.lit("file_status").alias("section"), F.col("status").alias("key")).agg(F.count("*").alias("value"))
    mode = info.select(F.lit("compatibility").alias("section"), F.lit("mode").alias("key"), compat_mode(F.col("old_schema_version"), F.col("new_schema_version")).alias("value"), F.lit("text").alias("value_type"))
    return overview(info, counts).unionByName(mode)


def evidence_notes(info: DataFrame, capabilities: DataFrame, summary: DataFrame) -> DataFrame:
    """topic, key, value, state and reason: facts of the inputs (one row), what could be compared (capability, old, new, comparison, reason), and summaries (key, value)."""
    none = F.lit(None).cast("string")
    facts = ["old_schema_version", "new_schema_version", "old_hash_coverage", "new_hash_coverage", "forced"]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in facts]))
    inputs = info.select(pairs.alias("p")).select(F.lit("input").alias("topic"), "p.key", "p.value", none.alias("state"), none.alias("reason"))
    could = capabilities.select(F.lit("capability").alias("topic"), F.col("capability").alias("key"), F.to_json(F.struct("old", "new")).alias("value"), F.col("comparison").alias("state"), "reason")
    return inputs.unionByName(could).unionByName(summary.select(F.lit("summary").alias("topic"), "key", F.col("value").cast("string").alias("value"), none.alias("state"), none.alias("reason")))


def root_labels(roots: DataFrame) -> DataFrame:
    """Root labels with their place in byte order; a snapshot has a few."""
    return roots.select("root_label", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("root_label")).cast("long").alias("place"))


def page(table: DataFrame) -> DataFrame:
    """A table of entries as one page: path, KEY, then all its columns."""
    return table.select(F.concat("root_label", F.lit("\\"), "rel_path").alias("path"), *KEY, *[c for c in table.columns if c not in KEY])


def _entry_path() -> Column:
    return path_of("root_label", "rel_path")


#: How records of a run are told apart, by type.
RECORD_KEYS = {
    "manifest": lambda: F.lit("manifest"),
    "run_event": lambda: F.concat(F.lit("event:"), F.col("event_seq").cast("string")),
    "session": lambda: F.col("session_id").cast("string"),
    "entry_attempt": lambda: F.concat(_entry_path(), F.lit("|"), F.col("stage"), F.lit("|attempt="), F.col("attempt_number").cast("string")),
    "read_performance": lambda: F.concat(_entry_path(), F.lit("|"), F.col("stage"), F.lit("|attempt="), F.col("attempt_number").cast("string")),
    "format_check": _entry_path,
    "state_event": lambda: F.concat(F.col("session_id").cast("string"), F.lit("|event="), F.col("session_event_seq").cast("string")),
    "stage_checkpoint": lambda: F.col("stage"),
    "runtime": lambda: F.col("snapshot_uuid"),
}
#: Fields of a run record: each the first of the columns that isn't null.
RECORD_FIELDS = {
    "session_id": ["session_id"],
    "stage": ["stage"],
    "status": ["session_status", "status", "state", "run_state"],
    "event": ["event"],
    "occurred_at_utc": ["occurred_at_utc", "recorded_at_utc", "checked_at_utc", "embedded_at_utc"],
    "started_at_utc": ["started_at_utc"],
    "updated_at_utc": ["updated_at_utc"],
    "ended_at_utc": ["ended_at_utc"],
    "tool_name": ["tool_name", "tool"],
    "tool_version": ["tool_version"],
    "bytes_read": ["bytes_read"],
    "elapsed_seconds": ["elapsed_seconds"],
    "decision": ["decision"],
    "reason": ["error_message", "candidate_reason", "end_reason", "last_error_message", "detail"],
}


def run_records(tables: dict[str, DataFrame]) -> DataFrame:
    """The tables of a run (by record type) in one shape: type, key, path of the entry, RECORD_FIELDS as text, and the whole record as JSON."""
    out = None
    for kind, df in tables.items():
        has_entry = "rel_path" in df.columns
        first = lambda names, df=df: F.coalesce(*[F.col(n).cast("string") for n in names if n in df.columns], F.lit(None).cast("string"))
        shaped = df.select(
            F.lit(kind).alias("record_type"), RECORD_KEYS[kind]().alias("record_key"), (_entry_path() if has_entry else F.lit(None).cast("string")).alias("entry_path"), *[first(names).alias(field) for field, names in RECORD_FIELDS.items()],
            F.to_json(F.struct(*[c for c in df.columns if c not in KEY]), {"ignoreNullFields": "false"}).alias("record_json"),
        )
        out = shaped if out is None else out.unionByName(shaped)
    return out


def issue_rows(sections: DataFrame) -> DataFrame:
    """The sections of an issue report (see ``issues.report``) with what they know besides as JSON."""
    more = ["unsupported_files", "low_confidence_records"]
    return sections.select("section_id", "execution", "issue_files", "issue_records", *more, "reason", F.to_json(F.struct(*more), {"ignoreNullFields": "false"}).alias("information_json"))
