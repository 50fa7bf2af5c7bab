"""Queries over stored snapshots and comparisons: published, read back, compared and exported, with their SQL.

The bundles hold the two snapshots of ``model`` in the tables of ``sources.schemas``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as fn
from cairn.operators import diff, issues
from cairn.sources import bundle, files, journals, sqlite, working
from cairn.sources.schemas import TABLES
from cairn.sources.storage import shared_dir

from . import projections
from .diff_queries import ORACLE_SQL as DIFF_SQL
from .diff_queries import compared
from .model import DIRS, ENTRIES, FAILED_DIR, FAILED_ROOT, RULES, SIDES, snapshot, table


def shaped(df: DataFrame, name: str) -> DataFrame:
    """Rows in the schema of a table; columns that they lack are null."""
    pairs = [c.split(" ") for c in TABLES[name].split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(kind).alias(n) for n, kind in pairs])


def bundle_of(s: SparkSession, d: str, newer: bool, keep: bool = False) -> bundle.Bundle:
    """One of the two snapshots as stored tables; with ``keep`` what they are made of is written once."""
    side = snapshot(s, d, newer, keep)
    e = side["entries"]
    when = F.element_at(F.split("event", " "), 2)
    reused = F.col("origin") == "reused"
    info = s.range(1).select(F.lit("new" if newer else "old").alias("snapshot_uuid"), F.lit("complete").alias("status"), F.lit(3).alias("schema_version"), F.lit(1).alias("path_key_rule"), F.lit("full").alias("hash_coverage"))
    entries = e.select(
        "root_label", "rel_path", "path_key", F.element_at(F.split("rel_path", "/"), -1).alias("name"), F.lit("txt").alias("extension"), F.lit("other").alias("media_kind"), F.col("size").alias("size_bytes"), F.col("mtime").cast("string").alias("modified_at_utc"), F.col("attrs").alias("attributes"),
        F.lit(0).alias("is_placeholder"), F.lit(1).alias("hard_link_count"), F.col("volume").alias("volume_serial"), F.col("file_id").alias("file_index_hex"), F.lit("done").alias("meta_status"), F.when(F.col("unstable"), "unstable").otherwise("done").alias("hash_status"),
    )
    hashes = e.where("hash_hex is not null").select("root_label", "rel_path", F.lit("sha256").alias("algorithm"), "hash_hex", "origin", F.when(reused, "old").alias("source_snapshot_uuid"), F.when(reused, when).alias("source_computed_at_utc"), F.when(~reused, when).alias("finished_at_utc"), F.lit("valid").alias("status"))
    # What the tool says differs between the snapshots by where the file was read, and for some files by its tags.
    text = F.concat(F.lit('{"File:Directory":"'), F.lit("there" if newer else "here"), F.lit('","tags":"'), F.col("payloads")["exiftool"]["sha"], F.lit('"}'))
    payloads = e.where(F.size("payloads") > 0).select("root_label", "rel_path", F.lit("exiftool").alias("provider"), text.alias("text"), F.lit("1").alias("provider_version"))
    payloads = payloads.withColumn("payload_zlib", files.deflate("text")).withColumn("payload_sha256", F.sha2(F.col("text").cast("binary"), 256)).withColumn("uncompressed_bytes", F.octet_length("text"))
    made = {"snapshot_info": info, "roots": side["roots"].withColumn("root_path", F.concat(F.lit("/"), "root_label")), "dirs": side["dirs"], "entries": entries, "hashes": hashes, "raw_payloads": payloads}
    return {name: shaped(df, name) for name, df in made.items()}


def published(s: SparkSession, d: str, newer: bool) -> bundle.Bundle:
    """The same, written, sealed, read back and held against its manifest."""
    path = bundle.publish_snapshot(bundle.described(bundle_of(s, d, newer, True)), f"{shared_dir(s)}/published-{uuid.uuid4().hex}")
    return bundle.read_snapshot(s, path, verify=True)


#: Entries of a SQLite file, about: its task holds it in memory, so larger snapshots get more files.
FILE_ENTRIES = 25_000


def imported(s: SparkSession, d: str, newer: bool) -> bundle.Bundle:
    """The same, from SQLite files: written by tasks, imported, published and read back."""
    folder = f"{shared_dir(s)}/sqlite-{uuid.uuid4().hex}"
    own = bundle_of(s, d, newer, True)
    sqlite.export_snapshot(own, folder, max(4, -(-own["entries"].count() // FILE_ENTRIES))).count()
    path = bundle.publish_snapshot(bundle.described(sqlite.import_snapshot(s, folder)), f"{shared_dir(s)}/imported-{uuid.uuid4().hex}")
    return bundle.read_snapshot(s, path, verify=True)


def diff_imported(s: SparkSession, d: str) -> DataFrame:
    """The comparison of a snapshot that came from SQLite files with one that was stored."""
    return diff.compare(*diff.comparison_sides(imported(s, d, False), published(s, d, True)))["entries"].select(*diff.RESULT)


#: Roots that are listed anew by ``reconciled``; the others aren't looked at.
LISTED_ANEW = ["src3", "src7", "src11"]


def reconciled(s: SparkSession, d: str) -> DataFrame:
    """A published snapshot brought to a new listing of some roots: changes by root, whether the rows are those of the listing now, and whether the files of a root are what they were."""
    path = f"{shared_dir(s)}/working-{uuid.uuid4().hex}"
    working.create(published(s, d, False), path)
    digests = lambda: {t: s.createDataFrame([(r.path.split("root_label=")[1].split("/")[0], r.sha256) for r in files.file_digests(s, f"{path}/{t}", "*.parquet").collect()], "root_label string, sha string") for t in ("entries", "hashes")}  # noqa: E731  # a file or so a root
    before = digests()
    new = bundle_of(s, d, True)
    listed = {t: new[t].where(F.col("root_label").isin(LISTED_ANEW)) for t in ("dirs", "entries")}
    changes = working.reconcile(s, path, {"dirs": listed["dirs"], "entries": listed["entries"].drop("meta_status", "hash_status")})
    after = digests()
    counted = changes.groupBy("root_label").agg(*[F.coalesce(F.sum(F.when((F.col("table") == "entries") & (F.col("change") == c), F.col("n"))), F.lit(0)).alias(c) for c in ("inserted", "updated", "kept", "removed")])
    now = working.read(s, path, ["entries", "hashes"])
    pending = now["entries"].groupBy("root_label").agg(F.count("*").alias("entries"), F.count_if(F.col("hash_status") == "pending").alias("pending"))
    hashes = now["hashes"].groupBy("root_label").agg(F.count("*").alias("hashes"))
    same = None
    for t in before:
        gone = before[t].unionByName(after[t]).groupBy("root_label", "sha").count().where("count <> 2").select("root_label").distinct().withColumn(f"{t}_written", F.lit(True))
        same = gone if same is None else same.join(gone, "root_label", "full_outer")
    out = pending.join(hashes, "root_label", "left").join(counted, "root_label", "left").join(same, "root_label", "left")
    return out.select("root_label", "entries", "pending", F.coalesce("hashes", F.lit(0)).alias("hashes"), *["inserted", "updated", "kept", "removed"], F.coalesce("entries_written", F.lit(False)).alias("entries_written"), F.coalesce("hashes_written", F.lit(False)).alias("hashes_written"))


def finished_attempts(s: SparkSession, d: str) -> DataFrame:
    """Attempts at every document's hash, metadata and format, closed in a working folder: statuses of entries, checks, attempts and performance rows."""
    path = f"{shared_dir(s)}/attempts-{uuid.uuid4().hex}"
    own = bundle_of(s, d, False)
    i = F.regexp_extract("rel_path", r"([0-9]+)[.]txt$", 1).cast("bigint")
    stages = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.lit(x).alias("stage")) for n, x in enumerate(("hash", "metadata", "format"))]))
    tried = own["entries"].select("root_label", "rel_path", i.alias("i"), stages.alias("x")).select("root_label", "rel_path", "i", "x.stage", (F.col("i") * 3 + F.col("x.k")).alias("attempt_id"), F.lit(1).cast("bigint").alias("attempt_number"), F.lit("running").alias("status"), F.lit("s1").alias("session_id"))
    checks = tried.where("stage = 'format'").select("root_label", "rel_path", "attempt_id", F.lit("zip").alias("validator"), F.lit("processing").alias("status"))
    working.create({"snapshot_info": own["snapshot_info"], "entries": own["entries"], "entry_attempts": shaped(tried, "entry_attempts"), "format_checks": shaped(checks, "format_checks"), "read_performance": shaped(tried.where("false"), "read_performance")}, path)
    outcome = F.when(F.col("i") % 7 == 0, "timeout").when(F.col("i") % 11 == 0, "unstable").otherwise("succeeded")
    read_at = F.when((F.col("stage") == "hash") & (F.col("i") % 2 == 0), F.struct(F.lit("computed").alias("origin"), F.col("i").alias("bytes_read"), (F.col("i") / 4).alias("elapsed_seconds")))
    done = tried.where("i % 5 <> 0").select("root_label", "rel_path", "attempt_id", outcome.alias("status"), F.lit("t1").alias("ended_at_utc"), F.col("i").alias("bytes_read"), read_at.alias("performance"))
    working.finish_attempts(s, path, done)
    now = working.read(s, path, ["entries", "entry_attempts", "format_checks", "read_performance"])
    told = lambda df, what, key, value: df.groupBy(F.lit(what).alias("what"), F.col(key).alias("key")).agg(value.cast("double").alias("value"))
    parts = [told(now["entries"], "hash_status", "hash_status", F.count("*")), told(now["entries"], "meta_status", "meta_status", F.count("*")), told(now["entry_attempts"], "attempt", "status", F.coalesce(F.sum("bytes_read"), F.lit(0))), told(now["format_checks"], "format", "status", F.count("*")), told(now["read_performance"], "performance", "origin", F.sum("elapsed_seconds"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def publish_evidence(s: SparkSession, d: str) -> DataFrame:
    """What a published snapshot says of its making: its events by name, its counts, and whether its name is its fingerprint."""
    lines = table(s, d, "events").select(F.to_json(F.struct(F.concat(F.lit("seen_"), "event_type").alias("event"), F.col("ts").cast("string").alias("ts"), "event_id")).alias("value"), F.concat(F.lit("seen_"), "event_type").alias("event"))
    path = bundle.publish_snapshot(bundle.described(bundle_of(s, d, True)), f"{shared_dir(s)}/evidence-{uuid.uuid4().hex}", lines)
    found = bundle.read_evidence(s, path)
    events = found["run_events"].groupBy(F.lit("event").alias("section"), F.col("event").alias("key")).agg(F.count("*").alias("value"))
    last = found["run_events"].agg(F.max("event_seq").alias("value"), F.max_by("event", "event_seq").alias("key")).select(F.lit("last").alias("section"), "key", "value")
    document = F.from_json("manifest_json", "struct<counts:map<string,bigint>,events:struct<count:bigint>>")
    counts = found["snapshot_manifest"].select(F.explode(document["counts"]).alias("key", "value")).select(F.lit("count").alias("section"), "key", "value")
    named = s.range(1).select(F.lit("name").alias("section"), F.lit("is fingerprint").alias("key"), F.lit(int(path.endswith("_" + bundle.fingerprint(s, path)))).cast("long").alias("value"))
    return events.unionByName(last).unionByName(counts).unionByName(named)


def diff_published(s: SparkSession, d: str) -> DataFrame:
    """The comparison of two snapshots that were stored and read back."""
    return diff.compare(*diff.comparison_sides(published(s, d, False), published(s, d, True)))["entries"].select(*diff.RESULT)


def info_of(s: SparkSession) -> DataFrame:
    return s.range(1).select(F.lit("d1").alias("diff_uuid"), F.lit("complete").alias("status"), F.lit(3).alias("old_schema_version"), F.lit(3).alias("new_schema_version"), F.lit("full").alias("old_hash_coverage"), F.lit("full").alias("new_hash_coverage"), F.lit(0).alias("forced"))


def diff_stored(s: SparkSession, d: str) -> DataFrame:
    """Counts of a comparison that was stored and read back."""
    path = bundle.publish_comparison(compared(s, d), info_of(s), f"{shared_dir(s)}/comparison-{uuid.uuid4().hex}")
    return diff.status_evidence(bundle.read_comparison(s, path, verify=True)["entries"])


def planted(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """A comparison with path keys that stand twice on the newer side and hard links that only it has."""
    old = snapshot(s, d, False)
    extra = old["entries"].withColumn("_id", F.conv("file_id", 16, 10).cast("long") - 1)
    twice = extra.where("_id % 43 = 6").withColumn("rel_path", F.upper("rel_path"))
    links = extra.where("_id % 47 = 3").withColumn("rel_path", F.concat(F.lit("links/"), F.col("_id").cast("string"), F.lit(".txt"))).withColumn("path_key", F.col("rel_path")).withColumn("event", F.concat(F.lit("link "), F.col("_id").cast("string")))
    entries = old["entries"]
    for more in (twice, links):
        entries = entries.unionByName(more.drop("_id"))
    return diff.compare(old, old | {"entries": entries})


PLANTED = f"""{SIDES},
c AS (SELECT * FROM o WHERE doc_id % 43 = 6), l AS (SELECT *, 'links/' || doc_id || '.txt' AS link FROM o WHERE doc_id % 47 = 3),
nn AS (SELECT hash, volume, file_id FROM o UNION ALL SELECT hash, volume, file_id FROM c UNION ALL SELECT hash, volume, file_id FROM l)"""


def planted_entries(s: SparkSession, d: str) -> DataFrame:
    return planted(s, d)["entries"].select("path_key", "old_root", "new_root", "old_path", "new_path", "status", "evidence", "reason")


def diff_overview(s: SparkSession, d: str) -> DataFrame:
    return projections.diff_overview(info_of(s).drop("status"), compared(s, d)["entries"])


def evidence_notes(s: SparkSession, d: str) -> DataFrame:
    docs, pages, labels = table(s, d, "documents"), table(s, d, "pages"), table(s, d, "labels")
    wanted = {"files": [], "directories": [], "metadata": ["doc_id"], "raw": [], "audio": ["page_id"]}
    old = bundle.capabilities(s, {"files": docs, "directories": docs.where("false"), "metadata": labels, "raw": None, "audio": pages.where("false")}, wanted)
    new = bundle.capabilities(s, {"files": docs, "directories": docs, "metadata": labels, "raw": pages, "audio": labels}, wanted)
    summary = diff.metadata_evidence(compared(s, d)["entries"]).select("kind", "n").withColumnsRenamed({"kind": "key", "n": "value"})
    return projections.evidence_notes(info_of(s), diff.comparison_capabilities(old, new), summary)


def flagged(s: SparkSession, d: str) -> DataFrame:
    """The flags that a snapshot declares, and whether its seal holds."""
    own = bundle.described(bundle_of(s, d, True))
    return bundle.seal_check(own).join(own["snapshot_info"].select("has_file_issues", "has_unstable", "has_gaps"), F.lit(True))


def gate(s: SparkSession, d: str) -> DataFrame:
    """What stands against sealing a snapshot whose documents without labels are still to be read."""
    docs = table(s, d, "documents").join(table(s, d, "labels").select("doc_id").distinct().withColumn("seen", F.lit(True)), "doc_id", "left")
    entries = docs.select(F.when(F.col("seen"), "done").otherwise("pending").alias("hash_status"), F.lit("done").alias("meta_status"))
    events = table(s, d, "events")
    return bundle.seal_gate({
        "entries": entries, "entry_attempts": events.select(F.when(F.col("event_type") == "error", "running").otherwise("succeeded").alias("status")), "format_checks": events.select(F.when(F.col("event_type") == "view", "processing").otherwise("valid").alias("status")),
        "stage_checkpoints": table(s, d, "nation").select(F.when(F.col("n_regionkey") == 1, "running").otherwise("complete").alias("state")),
    })


def findings(s: SparkSession, d: str) -> DataFrame:
    """Rules that rows break: sizes below 0, keys that stand twice, roots, entries, hashes and sources that aren't there."""
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("root_label"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"))
    i = F.col("doc_id")
    entries = docs.unionByName(docs.where("doc_id % 89 = 0")).select("root_label", "rel_path", F.col("rel_path").alias("path_key"), F.when(i % 97 == 0, -1).otherwise(i).alias("size_bytes"), F.lit(0).alias("is_placeholder"))
    origin = F.when(i % 13 == 0, "odd").when(i % 11 == 0, "reused").otherwise("computed")
    hashes = docs.select("root_label", F.when(i % 17 == 0, F.concat(F.lit("gone/"), "rel_path")).otherwise(F.col("rel_path")).alias("rel_path"), F.lit("sha256").alias("algorithm"), F.when(i % 7 != 0, F.sha2("rel_path", 256)).alias("hash_hex"), origin.alias("origin"), F.lit(None).cast("string").alias("source_snapshot_uuid"), F.lit("valid").alias("status"))
    roots = docs.where("root_label <> 'src0'").select("root_label", F.lit("ok").alias("enum_status")).distinct()
    return bundle.constraint_violations({"roots": roots, "entries": entries, "hashes": hashes})


def payload_rows(s: SparkSession, d: str) -> DataFrame:
    return files.checked_payloads(bundle_of(s, d, False)["raw_payloads"]).select("root_label", "rel_path", "provider", "uncompressed_bytes", "payload_sha256", "payload")


def error_rows(s: SparkSession, d: str) -> DataFrame:
    """Errors of files and folders with their paths, and diagnostics, in one shape."""
    docs = table(s, d, "documents")
    entries = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("entry"), F.col("source").alias("root_label"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"))
    dirs = docs.select("source", "lang").distinct().select(F.concat_ws("/", "source", "lang").alias("dir"), F.col("source").alias("root_label"), F.col("lang").alias("rel_path"))
    errors = docs.select(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("entry"), F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", "source", "lang")).alias("dir"), F.col("doc_id").alias("error_pk"), F.lit("hash").alias("stage"), F.lit("io_error").alias("error_code"), F.col("lang").alias("message"))
    said = table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("error_pk"), F.lit("metadata").alias("stage"), F.col("role").alias("error_code"))
    return projections.union_shaped({"error": projections.error_paths(errors, entries, dirs), "diagnostic": said})


def overview_rows(s: SparkSession, d: str) -> DataFrame:
    own = bundle_of(s, d, True)
    counts = issues.snapshot_counts(own["entries"].withColumnRenamed("size_bytes", "size"), own["dirs"], own["roots"], s.range(0), own["entries"].select(F.lit("none").alias("severity")).where("false"))
    return projections.overview(own["snapshot_info"].select("snapshot_uuid", "schema_version", "hash_coverage"), counts)


def count_rows(s: SparkSession, d: str) -> DataFrame:
    """Nested counts as rows."""
    text = F.concat(F.lit('{"a":{"b":{"c":{"d":'), F.col("doc_id").cast("string"), F.lit('}},"f":"g"},"e":"x"}'))
    return table(s, d, "documents").select("doc_id", F.explode(journals.flat_counts(text)).alias("x")).select("doc_id", "x.key", "x.value")


def deep_rows(s: SparkSession, d: str) -> DataFrame:
    """Objects 1 to 20 deep as rows, at whatever depth."""
    depth = (F.col("doc_id") % 20 + 1).cast("int")
    text = F.concat(F.repeat(F.lit('{"k":'), depth), F.lit('{"n":'), F.col("doc_id").cast("string"), F.lit(',"s":"{\\"x\\":1}","e":{}}'), F.repeat(F.lit("}"), depth))
    return journals.flat_rows(table(s, d, "documents").select("doc_id", text.alias("text")), "text", ["doc_id"])


def exported_modules(s: SparkSession, d: str) -> DataFrame:
    """Two exports of one input, whose rows were counted while they were written: rows and whether both digests of rows agree."""
    path = f"{shared_dir(s)}/modules-{uuid.uuid4().hex}"
    made = projections.project("files", bundle_of(s, d, True)["entries"])
    rows = [projections.export_module(df, f"{path}-{kind}", "files", kind, "new") for kind, df in (("csv", made), ("jsonl", made.repartition(3)))]
    both = rows[0].unionByName(rows[1])
    return both.agg(F.sum("rows").alias("rows"), (F.countDistinct("rows_digest") == 1).alias("one_digest"), F.max("input_identity").alias("input"), F.max(F.size("fields")).alias("fields"))


def run_records(s: SparkSession, d: str) -> DataFrame:
    """Attempts, reads, changes of state and stages as run records."""
    e = table(s, d, "events")
    key = [F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")).alias("root_label"), F.concat(F.lit("f/"), F.col("user_id").cast("string")).alias("rel_path")]
    attempts = e.select(*key, F.col("event_id").alias("attempt_number"), F.lit("hash").alias("stage"), F.col("event_type").alias("status"), F.lit("tool").alias("tool_name"), F.when(F.col("event_type") == "error", "failed").alias("error_message"), F.lit("ended").alias("end_reason"))
    reads = e.where("event_type = 'view'").select(*key, F.col("event_id").alias("attempt_number"), F.lit("hash").alias("stage"), F.col("event_id").alias("bytes_read"), F.lit("slow").alias("candidate_reason"))
    changes = e.where("event_type = 'click'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("session_event_seq"), F.col("event_type").alias("event"), F.lit("t0").alias("occurred_at_utc"))
    stages = table(s, d, "nation").select(F.col("n_name").alias("stage"), F.lit("complete").alias("state"), F.lit("t1").alias("started_at_utc"))
    return projections.run_records({"entry_attempt": attempts, "read_performance": reads, "state_event": changes, "stage_checkpoint": stages})


def identity(s: SparkSession, d: str) -> DataFrame:
    """Whether the tables that were read are what they were."""
    path = f"{d}/labels.parquet"
    before, after = bundle.input_identity(s, path), bundle.input_identity(s, path)
    return table(s, d, "labels").agg(F.count("*").alias("n")).withColumn("unchanged", F.lit(bundle.input_unchanged(before, after)))


def shown(s: SparkSession, d: str) -> DataFrame:
    """A preview of texts for people."""
    rows = table(s, d, "documents").select("doc_id", F.concat(F.chr(F.lit(7)), "lang").alias("lang"))
    return projections.preview(rows.orderBy("doc_id"), 50)


def exported(s: SparkSession, d: str) -> DataFrame:
    """The manifest of an exported module, without what the files' names and bytes make of it."""
    rows = table(s, d, "labels").select("doc_id", "quality")
    path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    projections.export_csv(rows, path)
    made = projections.module_manifest(rows, path, "labels", ["none"])
    return made.select("module_id", F.array_join("fields", ",").alias("fields"), "rows", F.array_join("warnings", ",").alias("warnings"), (F.size("artifacts") > 0).alias("has_files"))


QUERIES = {
    "diff_published": diff_published,
    "diff_stored": diff_stored,
    "diff_imported": diff_imported,
    "publish_evidence": publish_evidence,
    "reconciled_bundle": reconciled,
    "finished_attempts": finished_attempts,
    "diff_planted": planted_entries,
    "diff_planted_groups": lambda s, d: planted(s, d)["groups"],
    "file_changes": lambda s, d: projections.file_changes(compared(s, d)["entries"]),
    "directory_changes": lambda s, d: projections.directory_changes(compared(s, d)["dirs"]),
    "gap_rows": lambda s, d: projections.gap_rows(compared(s, d)["subtrees"]),
    "diff_overview": diff_overview,
    "evidence_notes": evidence_notes,
    "diff_summary": lambda s, d: (lambda c: diff.summary_rows(c["entries"], c["dirs"], c["subtrees"], c["groups"]))(compared(s, d)),
    "snapshot_flags": flagged,
    "seal_gate": gate,
    "constraint_findings": findings,
    "payload_rows": payload_rows,
    "error_rows": error_rows,
    "overview_rows": overview_rows,
    "count_rows": count_rows,
    "deep_rows": deep_rows,
    "exported_modules": exported_modules,
    "run_records": run_records,
    "input_identity": identity,
    "preview": shown,
    "module_manifest": exported,
    "root_labels": lambda s, d: projections.root_labels(snapshot(s, d, True)["roots"]),
    "hash_page": lambda s, d: projections.page(bundle_of(s, d, True)["hashes"]).select("path", "root_label", "rel_path", "hash_hex", "origin"),
    "file_rows": lambda s, d: projections.project("files", bundle_of(s, d, True)["entries"]).select("root_label", "rel_path", "logical_path", "name", "size_bytes", "modified_at_utc", "volume_serial", "file_index_hex", "hash_status"),
    "hash_rows": lambda s, d: projections.project("hashes", bundle_of(s, d, True)["hashes"]).select("root_label", "rel_path", "logical_path", "hash_hex", "origin", "source_snapshot_uuid", "finished_at_utc"),
    "directory_rows": lambda s, d: projections.directories(bundle_of(s, d, True)["dirs"]).select("root_label", "rel_path", "logical_path", "parent_rel_path", "enum_status"),
    "directory_problems": lambda s, d: projections.dir_problems(bundle_of(s, d, True)["dirs"]).select("root_label", "rel_path", "enum_status"),
}

_logical = lambda root, path: f"CASE WHEN {path} IS NOT NULL THEN CASE WHEN {path} = '' THEN {root} ELSE {root} || chr(92) || {path} END END"
_reused = f"doc_id % {RULES['reused'][0]} = {RULES['reused'][1]}"

ORACLE_SQL = {
    "diff_published": DIFF_SQL["diff_entries"],
    "diff_imported": DIFF_SQL["diff_entries"],
    "reconciled_bundle": f"""WITH {SIDES.strip()}, w AS (SELECT unnest({LISTED_ANEW}) AS root), b AS (SELECT coalesce(o.root, n.root) AS root, o.path IS NOT NULL AS had, n.path IS NOT NULL AS has, o.size IS NOT DISTINCT FROM n.size AND o.mtime IS NOT DISTINCT FROM n.mtime AS same, o.hash IS NOT NULL AND o.path IS NOT NULL AS hashed
          FROM o FULL JOIN n ON o.root = n.root AND o.path = n.path),
        c AS (SELECT root, count(*) FILTER (has AND NOT had) AS inserted, count(*) FILTER (has AND had AND NOT same) AS updated, count(*) FILTER (has AND had AND same) AS kept, count(*) FILTER (had AND NOT has) AS removed, count(*) FILTER (had) AS old_n, count(*) FILTER (has) AS new_n, count(*) FILTER (hashed) AS old_h, count(*) FILTER (hashed AND has) AS new_h FROM b GROUP BY root)
        SELECT root AS root_label, CASE WHEN anew THEN new_n ELSE old_n END AS entries, CASE WHEN anew THEN inserted + updated ELSE 0 END AS pending, CASE WHEN anew THEN new_h ELSE old_h END AS hashes, CASE WHEN anew THEN CAST(inserted AS BIGINT) END AS inserted, CASE WHEN anew THEN CAST(updated AS BIGINT) END AS updated, CASE WHEN anew THEN CAST(kept AS BIGINT) END AS kept, CASE WHEN anew THEN CAST(removed AS BIGINT) END AS removed,
          anew AND inserted + updated + removed > 0 AS entries_written, anew AND removed > 0 AS hashes_written FROM (SELECT *, root IN (SELECT root FROM w) AS anew FROM c) WHERE CASE WHEN anew THEN new_n ELSE old_n END > 0""",
    "finished_attempts": f"""WITH {SIDES.strip()}, s AS (SELECT doc_id AS i, doc_id % 5 <> 0 AS done, CASE WHEN doc_id % 7 = 0 THEN 'timeout' WHEN doc_id % 11 = 0 THEN 'unstable' ELSE 'succeeded' END AS outcome FROM o)
        SELECT 'hash_status' AS what, CASE WHEN NOT done THEN 'done' ELSE CASE outcome WHEN 'timeout' THEN 'error' WHEN 'unstable' THEN 'unstable' ELSE 'done' END END AS key, count(*)::DOUBLE AS value FROM s GROUP BY ALL UNION ALL SELECT 'meta_status', CASE WHEN NOT done THEN 'done' ELSE CASE outcome WHEN 'succeeded' THEN 'done' ELSE outcome END END, count(*) FROM s GROUP BY ALL
        UNION ALL SELECT 'attempt', CASE WHEN done THEN outcome ELSE 'running' END, sum(CASE WHEN done THEN 3 * i ELSE 0 END)::DOUBLE FROM s GROUP BY ALL UNION ALL SELECT 'format', CASE WHEN NOT done THEN 'processing' ELSE CASE outcome WHEN 'succeeded' THEN 'valid' ELSE outcome END END, count(*) FROM s GROUP BY ALL
        UNION ALL SELECT 'performance', 'computed', sum(i / 4)::DOUBLE FROM s WHERE done AND i % 2 = 0 HAVING count(*) > 0""",
    "publish_evidence": f"""WITH {SIDES.strip()}, s AS (SELECT 'seen_' || event_type AS key, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'snapshot_sealed', 1) SELECT 'event' AS section, key, n AS value FROM s UNION ALL SELECT 'last', 'snapshot_sealed', CAST(sum(n) AS BIGINT) FROM s UNION ALL SELECT 'name', 'is fingerprint', 1
        UNION ALL SELECT 'count', section || '.' || key, n FROM (SELECT 'total' AS section, 'entries' AS key, count(*) AS n FROM n UNION ALL SELECT 'total', 'bytes', CAST(coalesce(sum(size), 0) AS BIGINT) FROM n UNION ALL SELECT 'total', 'dirs', count(*) FROM nd UNION ALL SELECT 'total', 'errors', 0
          UNION ALL SELECT 'total', 'dir_errors', count(*) FROM nd WHERE root = '{FAILED_ROOT}' AND path = '{FAILED_DIR}' UNION ALL SELECT 'total', 'failed_roots', 0 UNION ALL SELECT 'kind', 'other', count(*) FROM n HAVING count(*) > 0 UNION ALL SELECT 'meta_status', 'done', count(*) FROM n HAVING count(*) > 0
          UNION ALL SELECT 'hash_status', CASE WHEN unstable THEN 'unstable' ELSE 'done' END, count(*) FROM n GROUP BY ALL)""",
    "diff_stored": DIFF_SQL["diff_status_evidence"],
    "diff_planted": f"""WITH {PLANTED.strip()} SELECT path AS path_key, root AS old_root, root AS new_root, path AS old_path, path AS new_path, 'unchanged' AS status, 'propagated_single_computation' AS evidence, CAST(NULL AS VARCHAR) AS reason FROM o WHERE doc_id % 43 <> 6
        UNION ALL SELECT path, root, NULL, path, NULL, 'unknown', 'insufficient', 'path_key_collision' FROM c UNION ALL SELECT path, NULL, root, NULL, path, 'unknown', 'insufficient', 'path_key_collision' FROM c UNION ALL SELECT path, NULL, root, NULL, upper(path), 'unknown', 'insufficient', 'path_key_collision' FROM c
        UNION ALL SELECT link, NULL, root, NULL, link, 'added', 'insufficient', 'hardlink_same_file_id' FROM l""",
    "diff_planted_groups": f"""WITH {PLANTED.strip()}, h AS (SELECT DISTINCT hash FROM l), a AS (SELECT hash, count(*) AS n FROM o GROUP BY hash), b AS (SELECT hash, count(*) AS n FROM nn GROUP BY hash), s AS (SELECT hash, count(*) AS n FROM (SELECT hash FROM nn GROUP BY hash, volume, file_id HAVING count(*) > 1) GROUP BY hash)
        SELECT hash AS hash_hex, a.n AS old_count, b.n AS new_count, CAST(0 AS BIGINT) AS old_hardlink_sets, coalesce(s.n, 0) AS new_hardlink_sets, a.n || '->' || b.n AS classification FROM h JOIN a USING (hash) JOIN b USING (hash) LEFT JOIN s USING (hash)""",
    "file_changes": f"""WITH {ENTRIES.strip()} SELECT e.path_key, old_root, new_root, old_path, new_path, {_logical("old_root", "old_path")} AS old_logical_path, {_logical("new_root", "new_path")} AS new_logical_path, status, evidence, reason, old_size, new_size, CAST(o.mtime AS VARCHAR) AS old_mtime, CAST(n.mtime AS VARCHAR) AS new_mtime, old_hash, new_hash,
        CASE WHEN o.hash IS NOT NULL THEN 'computed' END AS old_origin, CASE WHEN n.hash IS NOT NULL THEN CASE WHEN n.{_reused} THEN 'reused' ELSE 'computed' END END AS new_origin, metadata_changed,
        CASE WHEN reason = 'group_paired' OR status IN ('copied', 'added', 'deleted') THEN coalesce(new_hash, old_hash) END AS group_hash FROM e LEFT JOIN o ON o.root = old_root AND o.path = old_path LEFT JOIN n ON n.root = new_root AND n.path = new_path""",
    "directory_changes": f"WITH {SIDES.strip()}, {DIRS.strip()} SELECT path_key, old_root, new_root, old_path, new_path, {_logical('old_root', 'old_path')} AS old_logical_path, {_logical('new_root', 'new_path')} AS new_logical_path, status, old_enum, new_enum, reason FROM ds",
    "gap_rows": f"""WITH g AS ({DIFF_SQL["diff_gap_subtrees"]}) SELECT side, root_label, rel_path, {_logical("root_label", "rel_path")} AS logical_path, enum_status, affected_estimate FROM g""",
    "diff_overview": f"""WITH {ENTRIES.strip()} SELECT 'identity' AS section, key, value, type AS value_type FROM (VALUES ('diff_uuid', 'd1', 'text'), ('old_schema_version', '3', 'integer'), ('new_schema_version', '3', 'integer'), ('old_hash_coverage', 'full', 'text'), ('new_hash_coverage', 'full', 'text'), ('forced', '0', 'integer')) v(key, value, type)
        UNION ALL SELECT 'file_status', status, CAST(count(*) AS VARCHAR), 'integer' FROM e GROUP BY status UNION ALL SELECT 'compatibility', 'mode', '3/3', 'text'""",
    "evidence_notes": f"""WITH m AS ({DIFF_SQL["diff_metadata_evidence"]}) SELECT 'input' AS topic, key, value, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS reason FROM (VALUES ('old_schema_version', '3'), ('new_schema_version', '3'), ('old_hash_coverage', 'full'), ('new_hash_coverage', 'full'), ('forced', '0')) v(key, value)
        UNION ALL SELECT 'capability', key, '{{"old":"' || a || '","new":"' || b || '"}}', state, reason FROM (VALUES ('files', 'available', 'available', 'comparable', NULL), ('directories', 'empty', 'available', 'comparable', NULL), ('metadata', 'available', 'available', 'comparable', NULL),
          ('raw', 'unavailable', 'available', 'unavailable', 'old=unavailable: no reason recorded'), ('audio', 'empty', 'incompatible', 'unavailable', 'old=empty: executed without a record; new=incompatible: no reason recorded')) c(key, a, b, state, reason)
        UNION ALL SELECT 'summary', kind, CAST(n AS VARCHAR), NULL, NULL FROM m""",
    "diff_summary": f"""WITH cc AS ({DIFF_SQL["diff_conclusion"]}), se AS ({DIFF_SQL["diff_status_evidence"]}), dd AS ({DIFF_SQL["diff_dirs"]}), gg AS ({DIFF_SQL["diff_gap_subtrees"]}), ch AS ({DIFF_SQL["diff_changed_groups"]})
        SELECT 'conclusion' AS section, k AS key, v AS value FROM (SELECT unnest(['content', 'structure', 'content_breaking', 'structure_breaking', 'content_caveats', 'structure_caveats']) AS k, unnest([content, structure, CAST(content_breaking AS VARCHAR), CAST(structure_breaking AS VARCHAR), CAST(content_caveats AS VARCHAR), CAST(structure_caveats AS VARCHAR)]) AS v FROM cc)
        UNION ALL SELECT 'files', status || '/' || evidence, CAST(n AS VARCHAR) FROM se UNION ALL SELECT 'directories', status, CAST(count(*) AS VARCHAR) FROM dd GROUP BY status UNION ALL SELECT 'gaps', side || '/' || root_label || '/' || rel_path, CAST(affected_estimate AS VARCHAR) FROM gg
        UNION ALL SELECT 'contents', classification, CAST(count(*) AS VARCHAR) FROM ch GROUP BY classification""",
    "snapshot_flags": f"WITH {SIDES.strip()} SELECT true AS complete, true AS whole, true AS flags_hold, true AS counts_hold, 0 AS has_file_issues, CAST((SELECT coalesce(bool_or(unstable), false) FROM n) AS INTEGER) AS has_unstable, CAST((SELECT count(*) > 0 FROM nd WHERE root = '{FAILED_ROOT}' AND path = '{FAILED_DIR}') AS INTEGER) AS has_gaps",
    "seal_gate": """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS pending_entries, (SELECT count(*) FROM events WHERE event_type = 'error') AS running_attempts, (SELECT count(*) FROM events WHERE event_type = 'view') AS pending_checks, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS open_stages""",
    "constraint_findings": """WITH b AS (SELECT doc_id AS i, source FROM documents), e AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE i % 89 = 0), c AS (SELECT count(*) FILTER (i % 7 = 0) AS h7, count(*) FILTER (i % 13 <> 0 AND i % 11 = 0) AS h11, count(*) FILTER (i % 13 = 0) AS h13, count(*) FILTER (i % 17 = 0) AS h17, count(*) FILTER (i % 89 = 0) AS u FROM b),
        x AS (SELECT count(*) FILTER (i % 97 = 0) AS s, count(*) FILTER (source = 'src0') AS r FROM e) SELECT t AS "table", rule, n FROM (SELECT unnest(['roots', 'roots', 'entries', 'entries', 'entries', 'entries', 'entries', 'hashes', 'hashes', 'hashes', 'hashes', 'hashes', 'hashes']) AS t,
        unnest(['enum_status', 'unique', 'size', 'placeholder', 'path_key', 'unique', 'in roots', 'status', 'valid_has_hash', 'reused_has_source', 'origin', 'unique', 'in entries']) AS rule, unnest([0, 0, s, 0, 0, u, r, 0, h7, h11, h13, 0, h17]) AS n FROM c, x)""",
    "payload_rows": f"""WITH {SIDES.strip()}, p AS (SELECT root, path, '{{"File:Directory":"here","tags":"' || tags || '"}}' AS text FROM o WHERE tags IS NOT NULL) SELECT root AS root_label, path AS rel_path, 'exiftool' AS provider, CAST(strlen(text) AS BIGINT) AS uncompressed_bytes, sha256(text) AS payload_sha256, text AS payload FROM p""",
    "error_rows": """SELECT 'error' AS record_type, doc_id AS error_pk, 'hash' AS stage, 'io_error' AS error_code, lang AS message, CASE WHEN doc_id % 3 = 0 THEN source || chr(92) || lang WHEN doc_id % 5 <> 0 THEN source || chr(92) || lang || '/' || doc_id END AS logical_path FROM documents
        UNION ALL SELECT 'diagnostic', conv_id * 1000 + turn, 'metadata', role, NULL, NULL FROM conversations""",
    "overview_rows": f"""WITH {SIDES.strip()} SELECT 'identity' AS section, key, value, type AS value_type FROM (VALUES ('snapshot_uuid', 'new', 'text'), ('schema_version', '3', 'integer'), ('hash_coverage', 'full', 'text')) v(key, value, type)
        UNION ALL SELECT section, key, CAST(n AS VARCHAR), 'integer' FROM (SELECT 'total' AS section, 'entries' AS key, count(*) AS n FROM n UNION ALL SELECT 'total', 'bytes', CAST(coalesce(sum(size), 0) AS BIGINT) FROM n UNION ALL SELECT 'total', 'dirs', count(*) FROM nd UNION ALL SELECT 'total', 'errors', 0
          UNION ALL SELECT 'total', 'dir_errors', count(*) FROM nd WHERE root = '{FAILED_ROOT}' AND path = '{FAILED_DIR}' UNION ALL SELECT 'total', 'failed_roots', 0 UNION ALL SELECT 'kind', 'other', count(*) FROM n HAVING count(*) > 0 UNION ALL SELECT 'meta_status', 'done', count(*) FROM n HAVING count(*) > 0
          UNION ALL SELECT 'hash_status', CASE WHEN unstable THEN 'unstable' ELSE 'done' END, count(*) FROM n GROUP BY ALL)""",
    "deep_rows": """WITH d AS (SELECT doc_id, repeat('k.', CAST(doc_id % 20 + 1 AS INTEGER)) AS p FROM documents) SELECT doc_id, p || 'n' AS key, CAST(doc_id AS VARCHAR) AS value FROM d UNION ALL SELECT doc_id, p || 's', '{"x":1}' FROM d""",
    "exported_modules": f"WITH {SIDES.strip()} SELECT CAST(2 * count(*) AS BIGINT) AS rows, true AS one_digest, 'new' AS input, 17 AS fields FROM n",
    "count_rows": "SELECT doc_id, unnest(['a.b.c.d', 'a.f', 'e']) AS key, unnest([CAST(doc_id AS VARCHAR), 'g', 'x']) AS value FROM documents",
    "run_records": """WITH e AS (SELECT *, 'r' || user_id % 3 || chr(92) || 'f/' || user_id AS path FROM events), r AS (
        SELECT 'entry_attempt' AS record_type, path || '|hash|attempt=' || event_id AS record_key, path AS entry_path, NULL AS session_id, 'hash' AS stage, event_type AS status, NULL AS event, NULL AS occurred_at_utc, NULL AS started_at_utc, 'tool' AS tool_name, NULL AS bytes_read, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ended' END AS reason,
          '{"attempt_number":' || event_id || ',"stage":"hash","status":"' || event_type || '","tool_name":"tool","error_message":' || CASE WHEN event_type = 'error' THEN '"failed"' ELSE 'null' END || ',"end_reason":"ended"}' AS record_json FROM e
        UNION ALL SELECT 'read_performance', path || '|hash|attempt=' || event_id, path, NULL, 'hash', NULL, NULL, NULL, NULL, NULL, CAST(event_id AS VARCHAR), 'slow', '{"attempt_number":' || event_id || ',"stage":"hash","bytes_read":' || event_id || ',"candidate_reason":"slow"}' FROM e WHERE event_type = 'view'
        UNION ALL SELECT 'state_event', user_id || '|event=' || event_id, NULL, CAST(user_id AS VARCHAR), NULL, NULL, 'click', 't0', NULL, NULL, NULL, NULL, '{"session_id":' || user_id || ',"session_event_seq":' || event_id || ',"event":"click","occurred_at_utc":"t0"}' FROM e WHERE event_type = 'click'
        UNION ALL SELECT 'stage_checkpoint', n_name, NULL, NULL, n_name, 'complete', NULL, NULL, 't1', NULL, NULL, NULL, '{"stage":"' || n_name || '","state":"complete","started_at_utc":"t1"}' FROM nation)
        SELECT record_type, record_key, entry_path, session_id, stage, status, event, occurred_at_utc, started_at_utc, CAST(NULL AS VARCHAR) AS updated_at_utc, CAST(NULL AS VARCHAR) AS ended_at_utc, tool_name, CAST(NULL AS VARCHAR) AS tool_version, bytes_read, CAST(NULL AS VARCHAR) AS elapsed_seconds, CAST(NULL AS VARCHAR) AS decision, reason, record_json FROM r""",
    "input_identity": "SELECT count(*) AS n, true AS unchanged FROM labels",
    "preview": "SELECT doc_id, chr(65533) || lang AS lang FROM documents ORDER BY doc_id LIMIT 50",
    "module_manifest": "SELECT 'labels' AS module_id, 'doc_id,quality' AS fields, count(*) AS rows, 'none' AS warnings, true AS has_files FROM labels",
    "root_labels": f"WITH {SIDES.strip()} SELECT root AS root_label, row_number() OVER (ORDER BY root) AS place FROM (SELECT DISTINCT root FROM n)",
    "hash_page": f"WITH {SIDES.strip()} SELECT root || chr(92) || path AS path, root AS root_label, path AS rel_path, hash AS hash_hex, CASE WHEN {_reused} THEN 'reused' ELSE 'computed' END AS origin FROM n WHERE hash IS NOT NULL",
    "file_rows": f"WITH {SIDES.strip()} SELECT root AS root_label, path AS rel_path, root || chr(92) || path AS logical_path, string_split(path, '/')[-1] AS name, size AS size_bytes, CAST(mtime AS VARCHAR) AS modified_at_utc, volume AS volume_serial, lower(to_hex(file_id)) AS file_index_hex, CASE WHEN unstable THEN 'unstable' ELSE 'done' END AS hash_status FROM n",
    "hash_rows": f"WITH {SIDES.strip()} SELECT root AS root_label, path AS rel_path, root || chr(92) || path AS logical_path, hash AS hash_hex, CASE WHEN {_reused} THEN 'reused' ELSE 'computed' END AS origin, CASE WHEN {_reused} THEN 'old' END AS source_snapshot_uuid, CASE WHEN NOT ({_reused}) THEN CAST(doc_id AS VARCHAR) END AS finished_at_utc FROM n WHERE hash IS NOT NULL",
    "directory_rows": f"WITH {SIDES.strip()} SELECT root AS root_label, path AS rel_path, {_logical('root', 'path')} AS logical_path, CASE WHEN path <> '' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent_rel_path, CASE WHEN root = '{FAILED_ROOT}' AND path = '{FAILED_DIR}' THEN 'access_denied' ELSE 'ok' END AS enum_status FROM nd",
    "directory_problems": f"WITH {SIDES.strip()} SELECT root AS root_label, path AS rel_path, 'access_denied' AS enum_status FROM nd WHERE root = '{FAILED_ROOT}' AND path = '{FAILED_DIR}'",
}
