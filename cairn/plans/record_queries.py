"""Queries of history, verification, issue, disk and metadata operators over the driver's tables, with their SQL.

Ids stand for outcomes, so that every branch of an operator occurs; the SQL
computes what must come out from the same ids.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from cairn.functions import text as fn
from cairn.functions.payload import tag_map, tags
from cairn.operators import disks, history, issues, metadata, reconcile, stats, verify
from cairn.sources import bundle, files, journals
from cairn.sources.storage import shared_dir
from cairn.streaming import journal

from . import projections
from .function_queries import EXTENSIONS, KINDS, by_id, listed
from .model import table


def pick(words: list, i):
    return F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").withColumn("i", F.col("doc_id"))


# --- history and reconciliation

HASH_STATES = ["pending", "done", "error", "unstable", "skipped"]


def hash_stage(s: SparkSession, d: str) -> DataFrame:
    """What a hash stage makes of entries: placeholders, reused and computed hashes."""
    i, docs = F.col("i"), documents(s, d)
    keys = [F.col("source").alias("root_label"), F.concat("lang", F.lit("/"), i.cast("string")).alias("path_key")]
    plan = docs.where("i % 3 = 0").select(*keys, (i % 2 == 0).alias("reuse"), F.sha2(F.concat(F.lit("old"), i.cast("string")), 256).alias("hash_hex"))
    computed = docs.where("i % 7 <> 0").select(*keys, pick(["valid", "failed", "unstable", "valid"], i).alias("status"), F.when(i % 4 != 1, F.sha2(i.cast("string"), 256)).alias("hash_hex"))
    return reconcile.hash_stage(docs.select(*keys, (i % 5 == 0).alias("placeholder")), plan, computed)


def guards(s: SparkSession, d: str) -> DataFrame:
    """The error guard's word for each language, told for all and for those that failed more often."""
    docs = documents(s, d)
    every, worse, few = docs.select(F.when(F.col("i") % 4 == 0, "error").otherwise("done").alias("hash_status")), docs.select(F.when(F.col("i") % 3 > 0, "error").otherwise("done").alias("hash_status")), docs.where("i < 0").select(F.lit("error").alias("hash_status"))
    return docs.agg(F.count("*").alias("n")).select("n", *[F.lit(reconcile.error_rate_guard(df)).alias(name) for name, df in (("quarter", every), ("two_thirds", worse), ("none", few))])


def admissions(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return reconcile.previous_admission(documents(s, d).select((i % 3 == 0).alias("has_gaps"), (i % 5 == 0).alias("has_unstable"), (i % 7 == 0).cast("int").alias("hash_failures"), F.lit(1).alias("flags_recorded"), F.when(i % 11 == 0, 0).otherwise(1).alias("flags_found"))).groupBy("admitted", "reason").agg(F.count("*").alias("n"))


def verified(s: SparkSession, d: str) -> DataFrame:
    """Hashes of documents against two computations anew."""
    i, docs = F.col("i"), documents(s, d)
    right = F.sha2(i.cast("string"), 256)
    again = docs.where("i % 13 <> 0").select(i.alias("key"), F.when(i % 5 == 0, "x").otherwise(right).alias("first"), F.when(i % 10 == 0, right).when(i % 15 == 0, "x").otherwise(right).alias("second"), i.alias("size"), F.when(i % 17 == 0, 1).otherwise(0).cast("long").alias("mtime"))
    return reconcile.independent_verify(docs.select(i.alias("key"), right.alias("hash_hex"), i.alias("size"), F.lit(0).cast("long").alias("mtime")), again)


def recovered(s: SparkSession, d: str) -> DataFrame:
    """Attempts, entries and stages after a crash, and what then counts as current."""
    e = table(s, d, "events")
    attempts = e.select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), F.col("event_id").alias("attempt_number"), F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"))
    current = e.select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), F.lit("processing").alias("status")).distinct()
    stages = table(s, d, "nation").select(F.col("n_name").alias("stage"), F.when(F.col("n_regionkey") == 1, "running").otherwise("complete").alias("status"))
    found = history.recover_interrupted(attempts, current, stages)
    after = history.apply_attempts(found["current"], found["attempts"])
    count = lambda df, what: df.groupBy(F.lit(what).alias("what"), "status").agg(F.count("*").alias("n"))
    return count(found["attempts"], "attempts").unionByName(count(found["current"], "current")).unionByName(count(found["stages"], "stages")).unionByName(count(after, "applied"))


def retried(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    status, holder = pick(HASH_STATES, i), i % 7 == 0
    return documents(s, d).select("doc_id", history.retry_selection(status, holder, "transient").alias("transient"), history.retry_selection(status, holder, "all_unsuccessful").alias("all_unsuccessful"))


def latest_batch(s: SparkSession, d: str) -> DataFrame:
    """The batch twins of two streams: latest attempts and events without repeats."""
    e = table(s, d, "events").select(F.col("user_id").alias("entry"), F.col("event_type").alias("stage"), F.col("event_id").alias("attempt_number"), F.concat(F.lit("s"), (F.col("event_id") % 4).cast("string")).alias("status"), "ts")
    once = journal.distinct_events(e.select("entry", "stage", "ts"), ["entry", "stage"]).groupBy("entry").agg(F.count("*").alias("stages"))
    return journal.latest_attempts(e).join(once, "entry")


def comparable(s: SparkSession, d: str) -> DataFrame:
    """Reads that may be held against each other, and which of them were slow."""
    e, i = table(s, d, "events"), F.col("event_id")
    performance = e.select(i.alias("id"), F.col("user_id").alias("entry"), i.alias("attempt_number"), F.when(i % 9 == 0, "reused").otherwise("computed").alias("origin"), F.lit(2 << 20).cast("long").alias("size"), F.lit(2 << 20).cast("long").alias("bytes_read"), (1.0 + i % 3).cast("double").alias("seconds"), F.lit(0.0).alias("longest_stall"))
    attempts = e.select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), i.alias("attempt_number"), F.when(i % 5 == 0, "failed").otherwise("succeeded").alias("status"))
    u = F.col("entry")
    entries = e.select(F.col("user_id").alias("entry")).distinct().select("entry", F.concat(F.lit("r"), (u % 3).cast("string")).alias("root_label"), F.when(u % 2 == 0, "JPG").alias("extension"), F.lit("other").alias("media_kind"), F.when(u % 11 == 0, "error").otherwise("done").alias("hash_status"))
    roots = s.range(3).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("root_label"), F.when(F.col("id") > 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("volume_serial"))
    hashes = entries.select("entry", F.when(u % 13 == 0, "reused").otherwise("computed").alias("origin"), F.lit("valid").alias("status"))
    return stats.comparable_reads(performance, attempts, entries, roots, hashes)


# --- verification

FORMAT_STATES = ["valid", "invalid", "unsupported", "timeout", "error", "unstable", "missing"]


def checks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select(pick(["zip", "pdf", "media"], F.col("page_id")).alias("validator"), pick(FORMAT_STATES, F.col("page_id")).alias("status"))


def verdicts(s: SparkSession, d: str) -> DataFrame:
    """Verdicts from recorded tool output."""
    i = F.col("i")
    text = F.concat(F.lit("File Type : JPEG\n"), F.when(i % 5 == 0, "Warning : [minor] odd\n").when(i % 5 == 1, "Error : bad\n").when(i % 5 == 2, "Warning : Truncated data\n").when(i % 5 == 3, "Wrong password\n").otherwise(""), F.lit("no tag"))
    kind = pick(["media", "7z", "ole", "none"], i)
    said = fn.parse_tool_text(text)
    return documents(s, d).select("doc_id", verify.tool_verdict(kind, text, (i % 3).cast("int"), F.when(i % 7 == 0, 0).otherwise(1)).alias("verdict"), F.size(said).cast("long").alias("lines"), F.concat_ws("=", said[0]["tag"], said[0]["value"]).alias("first"), fn.issue_visible(F.lit("exiftool_reported_error"), F.when(i % 2 == 0, "Unknown  file type..").otherwise("bad")).alias("visible"), fn.diagnostic_class(F.lit("Warning"), F.lit("c"), F.when(i % 5 == 2, "Truncated data").when(i % 5 == 0, " [minor] x").otherwise("plain")).alias("class"))


def raw_rows(s: SparkSession, d: str) -> DataFrame:
    """RAW files and how their decodings ended."""
    i, docs = F.col("i"), documents(s, d)
    entries = docs.select(i.alias("key"), F.concat(F.lit("a/"), i.cast("string"), F.lit("."), by_id(EXTENSIONS)).alias("name"), i.alias("size"), F.lit(0).cast("long").alias("mtime"))
    decodes = docs.where("i % 5 <> 0").select(i.alias("key"), pick(["valid", "unsupported", "invalid"], i).alias("status"), i.alias("size"), F.when(i % 7 == 0, 1).otherwise(0).cast("long").alias("mtime"), F.lit(10).cast("long").alias("width"), (i % 4).alias("height"), i.alias("decoded_bytes"))
    return verify.raw_summary(entries, decodes)


def stat_rows(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(s, d)
    return docs.select(pick(["matched", "changed", "missing"], F.col("i")).alias("status")), docs.select(pick(["matched", "mismatched", "unverifiable", "timeout"], F.col("i")).alias("status"))


def verify_report(s: SparkSession, d: str) -> DataFrame:
    return verify.report_rows(*stat_rows(s, d), checks(s, d), raw_rows(s, d))


def conclusions(s: SparkSession, d: str) -> DataFrame:
    """The word for all sections, where one thing after another is the worst."""
    words = ["failed", "stopped", "issues", "unavailable"]
    sections = table(s, d, "pages").select(*[F.lit(False).alias(w) for w in words], (F.col("page_id") % 2 == 0).alias("unverifiable"))
    out = None
    for word in [*words, "unverifiable", "nothing"]:
        df = sections.withColumns({w: F.lit(w == word) for w in words})
        row = verify.conclusion(df if word != "nothing" else df.where("not unverifiable")).select(F.lit(word).alias("worst"), "conclusion")
        out = row if out is None else out.unionByName(row)
    return out


def failure_samples(s: SparkSession, d: str) -> DataFrame:
    failures = table(s, d, "events").select(F.col("event_type").alias("signature"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("path"))
    return verify.tool_failure_groups(failures, 3).select("signature", "affected", F.array_join("samples", ",").alias("samples"))


# --- issues


def issue_entries(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return documents(s, d).select(i.alias("entry"), F.col("source").alias("root_label"), F.concat("lang", F.lit("/"), i.cast("string")).alias("path_key"), F.when(i % 4 > 0, by_id(KINDS)).alias("media_kind"), pick(["done", "pending", "error", "timeout", "unstable"], i).alias("meta_status"), pick(HASH_STATES, i).alias("hash_status"), F.when(i % 3 == 0, "x").alias("file_id"))


def issue_errors(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    return documents(s, d).where("i % 2 = 0").select(i.alias("entry"), pick(["hash", "metadata"], i).alias("stage"), F.lit("exiftool_reported_error").alias("error_code"), F.when(i % 6 == 0, "Unsupported file type").otherwise("bad").alias("message"))


def folders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(s, d, "documents")
    roots = docs.select(F.col("source").alias("root_label")).distinct().withColumn("enum_status", F.when(F.col("root_label") == "src1", "failed").otherwise("ok"))
    dirs = docs.select(F.col("source").alias("root_label"), F.col("lang").alias("rel_path")).distinct().withColumn("enum_status", F.when(F.col("rel_path") == "de", "io_error").otherwise("ok"))
    return roots, dirs


def dense(s: SparkSession, d: str) -> DataFrame:
    """Entries with many warnings: a hundred make one worth a look."""
    e = table(s, d, "events").select((F.col("user_id") % 7).alias("entry"), F.col("event_id").alias("diagnostic_pk"), F.lit("warning").alias("severity"), F.lit("c").alias("diagnostic_code"), F.lit("plain").alias("message"))
    entries = s.range(7).select(F.col("id").alias("entry"), F.lit("done").alias("meta_status"))
    return issues.metadata_section(entries, e).select("entry", "warnings", "level")


def sessions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    ran = table(s, d, "orders").select(k.alias("session_id"), pick(["complete", "failed", "abandoned"], k).alias("status"), F.when(k % 2 == 0, "tool_circuit_open").alias("end_reason")).withColumn("session_id", F.col("session_id").cast("string"))
    stages = table(s, d, "nation").select(F.col("n_name").alias("stage"), F.when(F.col("n_regionkey") == 1, "failed_recoverable").otherwise("complete").alias("status"))
    events = table(s, d, "events").select(F.when(F.col("event_type") == "error", "tool_circuit_open").otherwise("other").alias("event_type"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"tool":"t'), (F.col("event_id") % 3).cast("string"), F.lit('","signature":"s"}'))).otherwise("{}").alias("payload"))
    return ran, stages, events


def issue_report(s: SparkSession, d: str) -> DataFrame:
    """All sections of an issue report; formats weren't checked in this run."""
    entries, (roots, dirs), e = issue_entries(s, d), folders(s, d), table(s, d, "events")
    attempts = e.where("event_id < 0").select(F.col("user_id").alias("entry"), F.lit("hash").alias("stage"), F.lit("failed").alias("status"))
    named = lambda df, **columns: df.select(*[F.col(v).alias(k) for k, v in columns.items()])
    gaps = issues.enumeration(roots, dirs).agg(F.count("*").alias("n"))
    slow = issues.performance_section(e.select(pick(["none", "low", "high"], F.col("event_id")).alias("confidence")))
    ran = issues.runtime_section(*sessions(s, d)).agg(F.count("*").alias("n"))
    raw = raw_rows(s, d).withColumn("bad", F.col("invalid"))
    sections = {
        "enumeration": named(gaps, issue_files="n", issue_records="n"), "hash": named(issues.hash_section(entries, issue_errors(s, d), attempts), issue_files="affected", issue_records="records"), "format": None,
        "raw": named(raw, issue_files="bad", issue_records="bad", unsupported_files="unsupported"), "performance": named(slow, issue_files="high", issue_records="high", low_confidence_records="low"), "runtime": named(ran, issue_files="n", issue_records="n"),
    }
    return projections.issue_rows(issues.report(sections, s))


def report_gate(s: SparkSession, d: str) -> DataFrame:
    """Whether there is anything to report."""
    n = table(s, d, "labels").groupBy("quality").agg(F.count("*").alias("n")).select(F.col("quality").cast("string").alias("section"), "n")
    none = table(s, d, "labels").select(F.lit("x").alias("section"), F.lit(None).cast("long").alias("n"))
    return issues.reportable(n).select(F.lit("found").alias("what"), "reportable").unionByName(issues.reportable(none).select(F.lit("not_executed").alias("what"), "reportable"))


def modules(s: SparkSession, d: str) -> DataFrame:
    """Modules by the worst of what they need."""
    capability = bundle.capabilities(s, {"documents": table(s, d, "documents"), "none": table(s, d, "labels").where("false"), "labels": table(s, d, "labels")}, {"documents": ["doc_id"], "none": ["doc_id"], "labels": ["missing"], "raw": []})
    needs = s.createDataFrame([("files", "documents"), ("both", "documents"), ("both", "none"), ("tags", "labels"), ("tags", "documents"), ("raw", "raw")], "module string, capability string")
    return bundle.module_status(needs, capability)


# --- disks


def disk_tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Parts stand for disks, line items for their partitions and attributes."""
    part, line, k = table(s, d, "part"), table(s, d, "lineitem"), F.col("p_partkey")
    own = part.select(k.alias("disk"), F.col("p_size").cast("long").alias("size"), F.when(k % 3 == 0, k % 2 == 0).alias("passed"), F.when(k % 4 > 0, k % 2).alias("critical_warning"), F.col("p_brand").alias("unique_id"), F.col("p_type").alias("serial"))
    parts = line.groupBy(F.col("l_partkey").alias("disk"), F.col("l_linenumber").cast("long").alias("offset")).agg(F.lit(1).cast("long").alias("size"), F.max(F.concat((F.col("l_linenumber") % 3).cast("string"), F.lit(":"))).alias("drive_letter"), F.max(F.when(F.col("l_linenumber") % 2 == 0, "data").otherwise("")).alias("label"))
    smart = line.select(F.col("l_partkey").alias("disk"), (F.col("l_linenumber") * 5).cast("long").alias("id"), F.when(F.col("l_returnflag") == "R", "now").alias("when_failed"), F.col("l_quantity").cast("long").alias("raw"))
    return {"disks": own, "partitions": parts, "smart": smart}


def disk_rows(s: SparkSession, d: str) -> DataFrame:
    t = disk_tables(s, d)
    found = disks.disk_summary(t["disks"], t["partitions"], disks.layout_gaps(t["partitions"], t["disks"]), disks.critical_smart(t["smart"]))
    return found.select("disk", "size", "health", F.array_join("letters", ",").alias("letters"), F.array_join("labels", ",").alias("labels"), "partitions", "partition_bytes", "failed", "attention", "gap_bytes")


def drift(s: SparkSession, d: str) -> DataFrame:
    own = disk_tables(s, d)["disks"].select("disk", "size", "unique_id", "serial")
    k = F.col("disk")
    after = own.where("disk % 5 <> 0").withColumn("size", F.when(k % 7 == 0, 0).otherwise(F.col("size"))).withColumn("serial", F.when(k % 3 == 0, "x").otherwise(F.col("serial")))
    return disks.same_disk(own.where("disk % 11 <> 0"), after).select("disk", F.array_join("drift", ",").alias("drift"))


def nvme(s: SparkSession, d: str) -> DataFrame:
    t, k = disk_tables(s, d), F.col("disk")
    logs = t["disks"].select("disk", (k % 20).alias("critical_warning"), (k % 100).alias("available_spare"), F.lit(10).alias("available_spare_threshold"), (k % 50).alias("percentage_used"), F.lit(None).cast("long").alias("unsafe_shutdowns"), (k % 2).alias("media_errors"), k.alias("num_err_log_entries"))
    return disks.nvme_fields(logs, t["smart"].where("disk % 2 = 0"))


def recorded_disks(s: SparkSession, d: str) -> DataFrame:
    """Profiles written as JSON and read again."""
    path = f"{shared_dir(s)}/profiles-{uuid.uuid4().hex}"
    k = F.col("p_partkey")
    volume = F.struct(F.lit("C").alias("drive_letter"), F.col("p_brand").alias("file_system_label"), F.col("p_size").cast("long").alias("size"), F.lit(0).cast("long").alias("size_remaining"))
    disk = F.struct(F.when(k % 9 > 0, k).alias("number"), F.col("p_name").alias("friendly_name"), F.col("p_type").alias("serial_number"), F.col("p_brand").alias("unique_id"), F.col("p_size").cast("long").alias("size"), F.lit("nvme").alias("bus_type"))
    part = F.array(F.struct(F.lit(1).cast("long").alias("partition_number"), k.alias("offset"), F.lit(5).cast("long").alias("size"), F.when(k % 2 == 0, volume).alias("volume")))
    # A file is one JSON document; this one lists the profiles of a hundredth of the disks.
    profiles = table(s, d, "part").select((k % 100).alias("file"), F.struct(disk.alias("disk"), part.alias("partitions")).alias("profile"))
    profiles.groupBy("file").agg(F.to_json(F.collect_list("profile")).alias("value")).repartition("file").write.partitionBy("file").text(path)
    found = journals.read_disk_profiles(s, path)
    return found["disks"].join(found["partitions"].select("disk", "offset", "drive_letter", "label"), "disk")


# --- sources


@F.pandas_udf(BinaryType())
def zipped(name: pd.Series, text: pd.Series) -> pd.Series:
    """One text as a ZIP of one member; its date is fixed."""

    def of(member: str, content: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(member, (2024, 3, 5, 6, 7, 8)), content, zipfile.ZIP_DEFLATED)
        return out.getvalue()

    return pd.Series([of(*x) for x in zip(name, text, strict=True)])


@F.pandas_udf(BinaryType())
def profiled(text: pd.Series, kind: pd.Series) -> pd.Series:
    """Disk profile archives, some of which aren't what their manifest says."""

    def of(content: str, k: int) -> bytes:
        raw, out = content.encode(), io.BytesIO()
        manifest = {"files": [{"name": "d.json", "size": len(raw) + (k == 2), "role": "other" if k == 3 else "disk"}], "collected_at": "2024-01-01T08:00:00+08:00", "collected_at_utc": "2024-01-01T00:00:01Z" if k == 4 else "2024-01-01T00:00:00Z"}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("d.json", raw)
            z.writestr("manifest.json", json.dumps(manifest))
            if k == 1:
                z.writestr("more.json", "")
        return out.getvalue()

    return pd.Series([of(*x) for x in zip(text, kind, strict=True)])


VERDICTS = ["valid", "members_differ", "sizes_differ", "roles_unknown", "times_differ"]


def profile_checks(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    made = table(s, d, "pages").select(k, profiled(F.coalesce("html", F.lit("")), k % 5).alias("content"))
    made = made.withColumn("path", F.concat(F.lit("/x/disk_"), k.cast("string"), F.lit("_"), F.when(k % 13 == 0, "00000000").otherwise(F.upper(F.substring(F.sha2("content", 256), 1, 8))), F.lit(".zip")))
    return files.profile_verdicts(made).groupBy("verdict").agg(F.count("*").alias("n"))


def zip_rows(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    made = table(s, d, "pages").select(k.cast("string").alias("path"), zipped(F.concat(F.lit("m/"), k.cast("string")), F.coalesce("html", F.lit(""))).alias("content"))
    return files.zip_members(made).select("path", "member_index", "member_path", "is_dir", "size_bytes", "method", "host_os", "flag_bits", "encrypted", "extract_version", "header_offset", "modified_raw")


def format_verdicts(s: SparkSession, d: str) -> DataFrame:
    """Checks of ZIP and PDF bytes, of which some are cut off."""
    k, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    packed = zipped(F.lit("m"), html)
    packed = F.when(k % 3 == 0, F.substring(packed, 1, 20)).when(k % 3 == 1, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), packed)).otherwise(packed)
    pdf = F.concat(F.lit("%PDF-1.7 "), html, F.when(k % 2 == 0, " startxref 1 %%EOF").otherwise(" startxref 1")).cast("binary")
    return table(s, d, "pages").select("page_id", files.validate_zip(packed).alias("zip"), files.validate_pdf(pdf).alias("pdf"))


def journal_events(s: SparkSession, d: str) -> DataFrame:
    """Turns of conversations written as journals in folders with like-named files, and read again."""
    path = f"{shared_dir(s)}/journal-{uuid.uuid4().hex}"
    line = F.to_json(F.struct(F.col("role").alias("event"), "conv_id", "turn"))
    table(s, d, "conversations").select((F.col("conv_id") % 3).alias("part"), line.alias("value")).write.partitionBy("part").text(path)
    return journals.read_journal(s, path).groupBy("event").agg(F.count("*").alias("n"))


def decodes(s: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(s, d, "events").select(F.col("user_id").alias("entry"), i.alias("sequence"), pick(["valid", "unsupported", "odd", "invalid"], i).alias("status"), (i % 3).alias("width"), F.lit(5).cast("long").alias("height"), F.when(i % 6 == 1, "p").alias("path"))
    return journals.decode_records(rows).select("entry", "sequence", "status")


def text_tree(s: SparkSession, d: str) -> str:
    """A tree of text files: one for each source and language, the documents in order of their ids."""
    path = f"{shared_dir(s)}/tree-{uuid.uuid4().hex}"
    docs = table(s, d, "documents").select("doc_id", "source", "lang", F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("value"))
    docs.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id").select("source", "lang", "value").write.partitionBy("source", "lang").text(path)
    return path


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def listed_tree(s: SparkSession, d: str) -> DataFrame:
    """Folders of a tree as listed from it."""
    roots = s.createDataFrame([("r", local(text_tree(s, d))), ("gone", "/nowhere/at/all")], "root_label string, root_path string")
    found = files.list_direct(roots, 4)
    per = found["entries"].where("extension = 'txt'").groupBy("root_label", fn.parent_path(F.col("rel_path")).alias("rel_path")).agg(F.count("*").alias("texts"))
    return found["dirs"].join(per, ["root_label", "rel_path"], "left").select("root_label", "rel_path", "enum_status", F.coalesce("texts", F.lit(0)).alias("texts"))


def tree_digests(s: SparkSession, d: str) -> DataFrame:
    """Digests of a tree's files by three readers."""
    path = text_tree(s, d)
    found = files.list_tree(s.createDataFrame([("r", local(path))], "root_label string, root_path string"), 4)
    own = files.digest_files(found["entries"].where("extension = 'txt'")).select(fn.parent_path(F.col("rel_path")).alias("folder"), "hash_hex", "status")
    folder = lambda c: F.regexp_extract(c, "(source=[^/]*/lang=[^/]*)/[^/]*$", 1)
    store = files.digest_store(s, path).where("path like '%.txt'").select(folder(F.col("path")).alias("folder"), F.col("hash_hex").alias("stored"))
    streamed = files.file_digests(s, path, "*.txt").select(folder(F.col("path")).alias("folder"), F.col("sha256").alias("streamed"))
    return own.join(store, "folder").join(streamed, "folder")


# --- metadata


def tagged(s: SparkSession, d: str, pairs: dict) -> DataFrame:
    doc = F.to_json(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())))
    rows = documents(s, d).select(F.col("i").alias("entry"), F.when(F.col("i") % 2 == 1, "dng").otherwise("cr3").alias("extension"), doc.alias("payload"))
    return tag_map(tags(rows, ["entry", "extension"]), ["entry", "extension"])


def text_of(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def dng_tags(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    n = i.cast("string")
    place = lambda k: F.when(i % 6 == 0, "0 deg 0' 0.00\" N").otherwise(text_of(((i + k) % 80).cast("string"), " deg 15' 0.00\" N"))
    return tagged(s, d, {
        "SubIFD:DefaultCropSize": F.when(i % 4 == 1, text_of((i + 1).cast("string"), " 20")).otherwise(F.lit("")), "SubIFD:ImageWidth": text_of("1", n), "ExifIFD:ExifImageWidth": text_of("2", n), "SubIFD:BitsPerSample": F.lit("14"), "ExifIFD:BitsPerSample": F.lit("8"),
        "Composite:GPSLatitude": place(0), "Composite:GPSLongitude": place(1), "ExifIFD:DateTimeOriginal": F.when(i % 3 == 0, "2024:01:02 03:04:05+02:00").otherwise("2024:01:02 03:04:05"), "XMP-xmp:CreateDate": F.lit("2024:01:02 03:04:05+01:00"), "ExifIFD:FocalLength": (i % 5).cast("string"),
    })


def photo_more(s: SparkSession, d: str) -> DataFrame:
    """Photos of two RAW formats: crops, places, bit depths and where times come from."""
    return metadata.photo(dng_tags(s, d)).select("entry", "width", "bit_depth", "gps_latitude", "gps_longitude", "capture_time_source", "capture_tz_offset_min", "capture_time_utc", "focal_length_mm")


def findings(s: SparkSession, d: str) -> DataFrame:
    return metadata.validation(dng_tags(s, d)).select("entry", "diagnostic_code", "field_name", "raw_value", "message")


def working_rows(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    pairs = {"IFD0:Software": F.lit("S"), "Photoshop:ColorMode": F.when(i % 2 == 0, "RGB").otherwise("n/a"), "XMP-photoshop:ColorMode": F.lit("CMYK"), "Photoshop:BitDepth": (i % 4 * 8).cast("string"), "File:ImageWidth": i.cast("string"), "ExifIFD:ExifImageHeight": F.lit("7"), "Photoshop:LayerCount": (i % 3).cast("string"), "Photoshop:LayerNames": F.lit("a, b"), "Photoshop:PhotoshopThumbnail": F.lit("(Binary)")}
    return metadata.working(tagged(s, d, pairs))


def document_rows(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    pairs = {"PDF:Title": text_of("T", i.cast("string")), "XMP:Creator": F.lit("C"), "PDF:Author": F.when(i % 2 == 0, "A").otherwise(""), "PDF:PageCount": (i % 9).cast("string"), "PDF:CreateDate": F.lit("2020:01:01 00:00:00"), "PDF:Encryption": F.lit("Standard")}
    return metadata.document(tagged(s, d, pairs))


def films(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    n = i.cast("string")
    head = F.when(i % 3 == 0, '"streams":[],').otherwise(text_of('"streams":[{"index":0,"codec_type":"', F.when(i % 3 == 1, "audio").otherwise("video"), '","codec_name":"c","duration":"', (i % 5).cast("string"), '","tags":{"TIMECODE":"01:00"}}],'))
    return documents(s, d).select(i.alias("entry"), F.concat(F.lit("{"), head, text_of('"format":{"format_name":"mov","duration":"', (i % 5).cast("string"), '.5","bit_rate":"', n, '","nb_streams":"1","tags":{"Title":"T', n, '","creation_time":"2024-02-03T04:05:06Z","artist":""}}}')).alias("payload"))


def film_metadata(s: SparkSession, d: str) -> DataFrame:
    i = F.col("i")
    tagged_ = tagged(s, d, {"QuickTime:CreateDate": F.when(i % 4 == 0, "2023:01:01 00:00:00+00:00").otherwise(""), "IFD0:Make": F.when(i % 5 == 0, "M").otherwise(""), "Microsoft:Category": F.when(i % 5 == 1, "x;model_name: FC1").otherwise("x"), "XMP:Author": F.lit("W")})
    return metadata.audio_video(tagged_, films(s, d))


def film_rows(s: SparkSession, d: str) -> DataFrame:
    return film_metadata(s, d).select("entry", "container_format", "duration_seconds", "bit_rate", "stream_count", "timecode", "capture_time_raw", "capture_time_source", "capture_time_utc", "camera_make", "camera_model", "title", "author")


def sound_rows(s: SparkSession, d: str) -> DataFrame:
    """Audio streams: what the stream tool saw, else what the tags say."""
    i = F.col("i")
    found = metadata.streams(films(s, d), "audio").select("entry", "stream_index", "codec_name", "duration_seconds", "sample_rate", "channels")
    pairs = {"File:FileType": F.when(i % 2 == 0, "AAC").otherwise("TXT"), "AAC:SampleRate": F.when(i % 4 == 0, "48000").otherwise(""), "AAC:Channels": (i % 3).cast("string"), "QuickTime:Duration": F.lit("2.5 s")}
    return metadata.audio_fallback(found, tagged(s, d, pairs).select("entry", "tags"))


def sound_faults(s: SparkSession, d: str) -> DataFrame:
    entries = documents(s, d).select(F.col("i").alias("entry"), F.when(F.col("i") % 2 == 0, "audio").otherwise("video_mp4").alias("media_kind"), F.when(F.col("i") % 8 == 0, 44).otherwise(1000).cast("long").alias("size"))
    return metadata.av_validation(entries, films(s, d))


def routed(s: SparkSession, d: str) -> DataFrame:
    """Entries by kind and what their normalisers gave, and errors among the diagnostics."""
    i = F.col("i")
    entries = documents(s, d).select(i.alias("entry"), by_id(EXTENSIONS).alias("extension"), by_id(KINDS).alias("media_kind"))
    made = metadata.normalized(entries, dng_tags(s, d).where("entry % 5 > 0").select("entry", "tags"), films(s, d).where("entry % 7 > 0"))
    counts = [df.groupBy(F.lit(name).alias("what"), F.lit("rows").alias("status")).agg(F.count("*").alias("n")) for name, df in made.items() if name != "meta_status"]
    said = documents(s, d).select(i.alias("entry"), pick(["error", "warning"], i).alias("severity"), F.lit("c").alias("diagnostic_code"), F.lit("m").alias("message"))
    outcomes = documents(s, d).select(F.col("i").alias("entry"), pick(["done", "skipped", "timeout"], i).alias("outcome")).unionByName(documents(s, d).select(F.col("i").alias("entry"), F.lit("not_applicable").alias("outcome")))
    more = [made["meta_status"].groupBy(F.lit("meta_status").alias("what"), F.col("meta_status").alias("status")).agg(F.count("*").alias("n")), metadata.diagnostic_errors(said).groupBy(F.lit("errors").alias("what"), F.col("error_code").alias("status")).agg(F.count("*").alias("n")), metadata.meta_status(outcomes).groupBy(F.lit("outcomes").alias("what"), F.col("meta_status").alias("status")).agg(F.count("*").alias("n"))]
    out = counts[0]
    for part in [*counts[1:], *more]:
        out = out.unionByName(part)
    return out


def payload_rows(s: SparkSession, d: str) -> DataFrame:
    """Payloads in canonical form with their digests."""
    return metadata.build_payload(films(s, d).withColumn("provider", F.lit("streams"))).select("entry", "provider", "payload_sha256", "uncompressed_bytes")


QUERIES = {
    "hash_stage": hash_stage, "error_guard": guards, "previous_admission": admissions, "independent_verify": verified, "recovery": recovered, "retry_selection": retried, "stream_twins": latest_batch, "comparable_reads": comparable,
    "comparable_outliers": lambda s, d: stats.outliers(comparable(s, d)).groupBy("group", "confidence").agg(F.count("*").alias("n")),
    "tool_verdicts": verdicts, "raw_summary": raw_rows, "format_summary": lambda s, d: verify.format_summary(checks(s, d)), "verify_report": verify_report, "verify_conclusion": conclusions, "tool_failure_samples": failure_samples,
    "report_flags": lambda s, d: issues.flags(issue_entries(s, d), *folders(s, d)[::-1], issue_errors(s, d)),
    "effective_profile": lambda s, d: issues.effective_profile(issue_entries(s, d), documents(s, d).select(pick(["valid", "failed", "unstable"], F.col("i")).alias("status")), table(s, d, "labels")),
    "evidence_gaps": lambda s, d: issues.evidence_gaps(documents(s, d).select(pick(["validation", "warning"], F.col("i")).alias("severity"), F.when(F.col("i") % 3 == 0, "historical_stream_payload_unavailable").otherwise("historical").alias("diagnostic_code"))),
    "enumeration_issues": lambda s, d: issues.enumeration(*folders(s, d)),
    "format_issues": lambda s, d: issues.format_section(checks(s, d)),
    "performance_issues": lambda s, d: issues.performance_section(table(s, d, "events").select(pick(["none", "low", "high"], F.col("event_id")).alias("confidence"))),
    "runtime_issues": lambda s, d: issues.runtime_section(*sessions(s, d)),
    "legacy_sections": lambda s, d: issues.legacy_sections(issue_entries(s, d), issue_errors(s, d), *folders(s, d)),
    "pending_by_kind": lambda s, d: issues.pending_by_kind(issue_entries(s, d)),
    "first_details": lambda s, d: issues.first_details(issue_entries(s, d).withColumn("level", pick(["candidate", "need_action", "information"], F.col("entry"))).select("level", "root_label", "path_key"), 40),
    "dense_warnings": dense, "issue_report": issue_report, "reportable": report_gate, "module_status": modules, "module_states": lambda s, d: bundle.module_state_counts(modules(s, d)),
    "disk_summary": disk_rows, "disk_drift": drift, "nvme_fields": nvme, "disk_profiles": recorded_disks,
    "profile_verdicts": profile_checks, "zip_members": zip_rows, "format_verdicts": format_verdicts, "journal_events": journal_events, "decode_records": decodes, "listed_tree": listed_tree, "tree_digests": tree_digests,
    "photo_formats": photo_more, "photo_findings": findings, "working_metadata": working_rows, "document_metadata": document_rows, "film_metadata": film_rows, "audio_streams": sound_rows, "audio_faults": sound_faults, "routed_metadata": routed, "canonical_payloads": payload_rows,
}

_said = lambda code: metadata.MESSAGES[code].replace("'", "''")
_ext, _kind = listed(EXTENSIONS), listed(KINDS)
_line = "SELECT l_partkey AS disk, l_linenumber AS k, l_returnflag, l_quantity FROM lineitem"

#: What photos' tags say, as CTE p.
PHOTOS = """p AS (SELECT doc_id AS i, doc_id % 2 = 1 AS dng, CASE WHEN doc_id % 6 = 0 THEN 0.0::DOUBLE ELSE doc_id % 80 + 0.25::DOUBLE END AS la, CASE WHEN doc_id % 6 = 0 THEN 0.0::DOUBLE ELSE (doc_id + 1) % 80 + 0.25::DOUBLE END AS lo FROM documents)"""
#: Counts of a RAW summary, as CTE raw.
RAW = f"""rw AS (SELECT doc_id AS i, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'unverifiable' ELSE {listed(["valid", "unsupported", "invalid"])} END AS state FROM documents WHERE {_ext} = 'CR2'),
raw AS (SELECT count(*) AS candidates, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'unsupported') AS unsupported, count(*) FILTER (state = 'unverifiable') AS unverifiable, count(*) FILTER (state = 'invalid') AS invalid, CAST(coalesce(sum(10 * (i % 4)) FILTER (state = 'valid'), 0) AS BIGINT) AS pixels, CAST(coalesce(sum(i) FILTER (state = 'valid'), 0) AS BIGINT) AS decoded_bytes FROM rw)"""
#: Entries and errors of issue reports, as CTEs ie and er; gaps, as CTE gaps; what a run failed in, as CTE ran.
ISSUES = f"""ie AS (SELECT doc_id AS i, source AS root_label, lang || '/' || doc_id AS path_key, CASE WHEN doc_id % 4 > 0 THEN {_kind} END AS media_kind, {listed(["done", "pending", "error", "timeout", "unstable"])} AS meta_status, {listed(HASH_STATES)} AS hash_status FROM documents),
er AS (SELECT doc_id AS i, {listed(["hash", "metadata"])} AS stage, doc_id % 6 <> 0 AS shown FROM documents WHERE doc_id % 2 = 0),
gaps AS (SELECT DISTINCT source AS root_label, '' AS rel_path, 'failed' AS enum_status FROM documents WHERE source = 'src1' UNION ALL SELECT DISTINCT source, lang, 'io_error' FROM documents WHERE lang = 'de'),
ran AS (SELECT 'session' AS kind, CAST(o_orderkey AS VARCHAR) AS id, {listed(["complete", "failed", "abandoned"], "o_orderkey")} AS detail FROM orders WHERE o_orderkey % 3 > 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT 'stage', n_name, 'failed_recoverable' FROM nation WHERE n_regionkey = 1
  UNION ALL SELECT 'tool', CASE WHEN event_id % 2 = 0 THEN 't' || event_id % 3 ELSE 'unknown' END, CASE WHEN event_id % 2 = 0 THEN 's' END FROM events WHERE event_type = 'error')"""
#: Reads that may be compared, as CTE cr.
READS = """la AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id),
cr AS (SELECT event_id AS id, concat_ws('/', CASE WHEN user_id % 3 > 0 THEN 'v' || user_id % 3 ELSE 'root:r0' END, CASE WHEN user_id % 2 = 0 THEN 'ext:jpg' ELSE 'kind:other' END, '21') AS "group", CAST(2097152 AS BIGINT) AS size, CAST(2097152 AS BIGINT) AS bytes_read, (1 + event_id % 3)::DOUBLE AS seconds, 0.0::DOUBLE AS longest_stall
  FROM la WHERE event_id % 9 <> 0 AND event_id % 5 <> 0 AND user_id % 11 <> 0 AND user_id % 13 <> 0)"""
_film = """'{"format":{"bit_rate":"' || i || '","duration":"' || i % 5 || '.5","format_name":"mov","nb_streams":"1","tags":{"Title":"T' || i || '","artist":"","creation_time":"2024-02-03T04:05:06Z"}},"streams":[' || CASE WHEN i % 3 = 0 THEN '' ELSE '{"codec_name":"c","codec_type":"' || CASE WHEN i % 3 = 1 THEN 'audio' ELSE 'video' END || '","duration":"' || i % 5 || '","index":0,"tags":{"TIMECODE":"01:00"}}' END || ']}'"""
_modules = """m AS (SELECT * FROM (VALUES ('files', 'available', (SELECT count(*) FROM documents)), ('both', 'empty', (SELECT count(*) FROM documents)), ('tags', 'incompatible', NULL), ('raw', 'unavailable', NULL)) v(module, state, rows))"""

ORACLE_SQL = {
    "hash_stage": f"""WITH b AS (SELECT doc_id AS i, source AS root_label, lang || '/' || doc_id AS path_key, doc_id % 5 = 0 AS holder, doc_id % 6 = 0 AS reuse, CASE WHEN doc_id % 7 <> 0 THEN {listed(["valid", "failed", "unstable", "valid"])} END AS st FROM documents)
        SELECT root_label, path_key, CASE WHEN holder THEN 'skipped' WHEN reuse THEN 'done' WHEN st = 'valid' THEN 'done' WHEN st = 'failed' THEN 'error' WHEN st = 'unstable' THEN 'unstable' ELSE 'pending' END AS hash_status, CASE WHEN NOT holder THEN CASE WHEN reuse THEN sha256('old' || i) WHEN st IS NOT NULL AND i % 4 <> 1 THEN sha256(CAST(i AS VARCHAR)) END END AS hash_hex,
          CASE WHEN holder THEN NULL WHEN reuse THEN 'reused' WHEN st IS NOT NULL THEN 'computed' END AS origin FROM b""",
    "error_guard": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS a, count(*) FILTER (doc_id % 3 > 0) AS b FROM documents) SELECT n, CASE WHEN n < 20 OR a <= 0.2 * n THEN 'ok' WHEN a <= 0.5 * n THEN 'warn' ELSE 'abort' END AS quarter, CASE WHEN n < 20 OR b <= 0.2 * n THEN 'ok' WHEN b <= 0.5 * n THEN 'warn' ELSE 'abort' END AS two_thirds, 'ok' AS "none" FROM c""",
    "previous_admission": """SELECT reason IS NULL AS admitted, reason, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'flags_differ' WHEN doc_id % 3 = 0 THEN 'gaps' WHEN doc_id % 7 = 0 THEN 'hash_failures' WHEN doc_id % 5 = 0 THEN 'unstable' END AS reason FROM documents) GROUP BY ALL""",
    "independent_verify": """SELECT doc_id AS key, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'verify_source_changed' WHEN doc_id % 5 = 0 THEN 'verify_mismatch' ELSE 'matched' END AS outcome, CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 OR doc_id % 5 = 0 THEN 'unstable' END AS hash_status FROM documents""",
    "recovery": """WITH a AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'abandoned' WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status FROM events), l AS (SELECT user_id, arg_max(status, event_id) AS status FROM a GROUP BY user_id)
        SELECT 'attempts' AS what, status, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'current', 'pending', count(*) FROM l HAVING count(*) > 0 UNION ALL SELECT 'stages', CASE WHEN n_regionkey = 1 THEN 'failed_recoverable' ELSE 'complete' END, count(*) FROM nation GROUP BY ALL
        UNION ALL SELECT 'applied', CASE status WHEN 'succeeded' THEN 'done' WHEN 'abandoned' THEN 'pending' ELSE 'error' END, count(*) FROM l GROUP BY ALL""",
    "retry_selection": "SELECT doc_id, doc_id % 5 = 2 AND doc_id % 7 <> 0 AS transient, doc_id % 5 IN (2, 3, 4) AND doc_id % 7 <> 0 AS all_unsuccessful FROM documents",
    "stream_twins": """WITH l AS (SELECT user_id AS entry, event_type AS stage, max(event_id) AS attempt_number FROM events GROUP BY ALL), n AS (SELECT entry, count(*) AS stages FROM l GROUP BY entry) SELECT entry, stage, 's' || attempt_number % 4 AS status, attempt_number, stages FROM l JOIN n USING (entry)""",
    "comparable_reads": f"WITH {READS} SELECT * FROM cr",
    "comparable_outliers": f"""WITH {READS}, r AS (SELECT *, bytes_read / seconds AS rate FROM cr), g AS (SELECT "group", count(*) AS n, median(rate) AS med FROM r GROUP BY "group"), h AS (SELECT "group", n, med, median(abs(rate - med)) AS mad FROM r JOIN g USING ("group") GROUP BY ALL)
        SELECT "group", CASE WHEN n < 8 THEN 'none' WHEN mad = 0 THEN CASE WHEN rate / med <= 0.25 THEN 'high' WHEN rate / med <= 0.5 THEN 'low' ELSE 'none' END WHEN (med - rate) / (1.4826 * mad) >= 6 AND rate / med <= 0.5 THEN 'high' WHEN (med - rate) / (1.4826 * mad) >= 3.5 AND rate / med <= 0.75 THEN 'low' ELSE 'none' END AS confidence, count(*) AS n FROM r JOIN h USING ("group") GROUP BY ALL""",
    "tool_verdicts": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 5 IN (1, 2) OR doc_id % 7 = 0 THEN 'invalid' WHEN doc_id % 3 <> 0 THEN 'error' ELSE 'valid' END WHEN 3 THEN 'unsupported' ELSE CASE WHEN doc_id % 3 = 0 THEN 'valid' WHEN doc_id % 5 = 3 THEN 'unsupported' ELSE 'invalid' END END AS verdict,
        CAST(CASE WHEN doc_id % 5 IN (0, 1, 2) THEN 2 ELSE 1 END AS BIGINT) AS lines, 'File Type=JPEG' AS first, doc_id % 2 <> 0 AS visible, CASE doc_id % 5 WHEN 2 THEN 'candidate' WHEN 0 THEN 'minor' ELSE 'warning' END AS class FROM documents""",
    "raw_summary": f"WITH {RAW} SELECT * FROM raw",
    "format_summary": "SELECT " + ", ".join(f"count(*) FILTER (page_id % 7 = {k}) AS {w}" for k, w in enumerate(FORMAT_STATES)) + ", count(*) FILTER (page_id % 7 <> 2) AS checked FROM pages",
    "verify_report": f"""WITH {RAW} SELECT 'stat' AS section, count(*) AS checked, count(*) FILTER (doc_id % 3 <> 0) AS problems FROM documents UNION ALL SELECT 'hash', count(*) FILTER (doc_id % 4 <> 2), count(*) FILTER (doc_id % 4 IN (1, 3)) FROM documents
        UNION ALL SELECT 'format', count(*) FILTER (page_id % 7 <> 2), count(*) FILTER (page_id % 7 NOT IN (0, 2)) FROM pages UNION ALL SELECT 'raw', candidates - unsupported - unverifiable, invalid FROM raw""",
    "verify_conclusion": "SELECT * FROM (VALUES ('failed', 'failed'), ('stopped', 'stopped'), ('issues', 'issues_found'), ('unavailable', 'incomplete'), ('unverifiable', 'incomplete'), ('nothing', 'passed')) v(worst, conclusion) WHERE EXISTS (SELECT 1 FROM pages)",
    "tool_failure_samples": "SELECT event_type AS signature, count(*) AS affected, array_to_string(list_slice(list_sort(list(lpad(CAST(event_id AS VARCHAR), 9, '0'))), 1, 3), ',') AS samples FROM events GROUP BY event_type",
    "report_flags": f"""WITH {ISSUES} SELECT (SELECT bool_or(meta_status IN ('error', 'timeout') OR hash_status = 'error') FROM ie) OR (SELECT bool_or(shown) FROM er) AS has_file_issues, (SELECT bool_or(meta_status = 'unstable' OR hash_status = 'unstable') FROM ie) AS has_unstable, (SELECT count(*) > 0 FROM gaps) AS has_gaps""",
    "effective_profile": "SELECT (SELECT count(*) FROM labels) AS payloads, count(*) FILTER (doc_id % 3 = 0) AS file_ids, count(*) FILTER (doc_id % 3 = 0) AS valid_hashes FROM documents",
    "evidence_gaps": "SELECT count(*) FILTER (doc_id % 6 = 0) AS n FROM documents",
    "enumeration_issues": f"WITH {ISSUES} SELECT * FROM gaps",
    "format_issues": f"SELECT {listed(['zip', 'pdf', 'media'], 'page_id')} AS validator, {listed(FORMAT_STATES, 'page_id')} AS status, count(*) AS n FROM pages WHERE page_id % 7 NOT IN (0, 6) GROUP BY ALL",
    "performance_issues": "SELECT count(*) FILTER (event_id % 3 = 2) AS high, count(*) FILTER (event_id % 3 = 1) AS low FROM events",
    "runtime_issues": f"WITH {ISSUES} SELECT * FROM ran",
    "legacy_sections": f"""WITH {ISSUES}, u AS (SELECT i FROM er GROUP BY i HAVING NOT bool_or(shown)) SELECT 'errors' AS section, count(*) FILTER (shown) AS n FROM er UNION ALL SELECT 'status', count(*) FROM ie WHERE (meta_status IN ('error', 'timeout', 'unstable') OR hash_status IN ('error', 'unstable')) AND i NOT IN (SELECT i FROM u)
        UNION ALL SELECT 'roots', count(*) FILTER (enum_status = 'failed') FROM gaps UNION ALL SELECT 'dirs', count(*) FILTER (enum_status = 'io_error') FROM gaps""",
    "pending_by_kind": f"WITH {ISSUES} SELECT coalesce(media_kind, 'unknown') AS media_kind, count(*) AS n FROM ie WHERE meta_status = 'pending' GROUP BY ALL",
    "first_details": f"WITH {ISSUES}, l AS (SELECT {listed(['candidate', 'need_action', 'information'], 'i')} AS level, root_label, path_key FROM ie), r AS (SELECT *, row_number() OVER (ORDER BY level = 'need_action' DESC, root_label, path_key) AS place FROM l) SELECT * FROM r WHERE place <= 40",
    "dense_warnings": "SELECT user_id % 7 AS entry, count(*) AS warnings, 'candidate' AS level FROM events GROUP BY 1 HAVING count(*) >= 100",
    "issue_report": f"""WITH {ISSUES}, {RAW}, h AS (SELECT coalesce(a.i, b.i) AS i, a.i IS NOT NULL AS s, coalesce(e, 0) AS e FROM (SELECT i FROM ie WHERE hash_status IN ('error', 'unstable')) a FULL JOIN (SELECT i, count(*) AS e FROM er WHERE stage = 'hash' GROUP BY i) b ON a.i = b.i),
        t AS (SELECT 'enumeration' AS section_id, count(*) AS f, count(*) AS r, NULL AS u, NULL AS lo FROM gaps UNION ALL SELECT 'hash', count(*), CAST(coalesce(sum(e + CASE WHEN s AND e = 0 THEN 1 ELSE 0 END), 0) AS BIGINT), NULL, NULL FROM h UNION ALL SELECT 'raw', invalid, invalid, unsupported, NULL FROM raw
          UNION ALL SELECT 'performance', count(*) FILTER (event_id % 3 = 2), count(*) FILTER (event_id % 3 = 2), NULL, count(*) FILTER (event_id % 3 = 1) FROM events UNION ALL SELECT 'runtime', count(*), count(*), NULL, NULL FROM ran UNION ALL SELECT 'format', NULL, NULL, NULL, NULL)
        SELECT section_id, CASE WHEN section_id = 'format' THEN 'not_executed' ELSE 'executed' END AS execution, CAST(f AS BIGINT) AS issue_files, CAST(r AS BIGINT) AS issue_records, CAST(u AS BIGINT) AS unsupported_files, CAST(lo AS BIGINT) AS low_confidence_records, CASE WHEN section_id = 'format' THEN 'not part of this run' END AS reason,
          '{{"unsupported_files":' || coalesce(CAST(u AS VARCHAR), 'null') || ',"low_confidence_records":' || coalesce(CAST(lo AS VARCHAR), 'null') || '}}' AS information_json FROM t""",
    "reportable": "SELECT 'found' AS what, count(*) > 0 AS reportable FROM labels UNION ALL SELECT 'not_executed', false",
    "module_status": f"WITH {_modules} SELECT * FROM m",
    "module_states": f"WITH {_modules} SELECT s AS state, (SELECT count(*) FROM m WHERE state = s) AS n FROM (SELECT unnest(['available', 'empty', 'unavailable', 'incompatible', 'invalid']) AS s)",
    "disk_summary": f"""WITH l AS ({_line}), p AS (SELECT DISTINCT disk, k FROM l), o AS (SELECT disk, count(*) AS partitions, list(CAST(k % 3 AS VARCHAR) || ':' ORDER BY k) AS ls, list(CASE WHEN k % 2 = 0 THEN 'data' ELSE '' END ORDER BY k) AS bs FROM p GROUP BY disk),
        s AS (SELECT disk, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag <> 'R' AND trunc(l_quantity) > 0) AS attention FROM l WHERE k IN (1, 2) GROUP BY disk),
        e AS (SELECT disk, k, lag(k + 1, 1, 0) OVER (PARTITION BY disk ORDER BY k) AS cur FROM p), g AS (SELECT e.disk, sum(greatest(k - cur, 0)) AS inner_gap, max(k + 1) AS last FROM e GROUP BY e.disk)
        SELECT p_partkey AS disk, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'passed' ELSE 'failed' END WHEN p_partkey % 4 = 0 THEN 'unknown' WHEN p_partkey % 2 = 0 THEN 'passed' ELSE 'warning' END AS health,
          CASE WHEN o.disk IS NOT NULL THEN array_to_string(list_filter(ls, lambda x, j: list_position(ls, x) = j), ',') END AS letters, CASE WHEN o.disk IS NOT NULL THEN CASE WHEN list_contains(bs, 'data') THEN 'data' ELSE '' END END AS labels, coalesce(partitions, 0) AS partitions, coalesce(partitions, 0) AS partition_bytes,
          coalesce(failed, 0) AS failed, coalesce(attention, 0) AS attention, CAST(coalesce(inner_gap, 0) + greatest(p_size - coalesce(last, 0), 0) AS BIGINT) AS gap_bytes FROM part LEFT JOIN o ON o.disk = p_partkey LEFT JOIN s ON s.disk = p_partkey LEFT JOIN g ON g.disk = p_partkey""",
    "disk_drift": """SELECT p_partkey AS disk, CASE WHEN p_partkey % 11 = 0 THEN 'new' WHEN p_partkey % 5 = 0 THEN 'gone' ELSE concat_ws(',', CASE WHEN p_partkey % 7 = 0 AND p_size <> 0 THEN 'size' END, CASE WHEN p_partkey % 3 = 0 AND p_type <> 'x' THEN 'serial' END) END AS drift FROM part WHERE NOT (p_partkey % 11 = 0 AND p_partkey % 5 = 0)""",
    "nvme_fields": f"""WITH l AS ({_line}), have AS (SELECT DISTINCT disk FROM l WHERE k IN (1, 2) AND disk % 2 = 0) SELECT p_partkey AS disk, CAST(unnest(range(1, 8)) AS BIGINT) AS place, unnest({disks.NVME}) AS field,
        unnest(['0x' || lpad(upper(to_hex(p_partkey % 20)), 2, '0'), CAST(p_partkey % 100 AS VARCHAR), '10', CAST(p_partkey % 50 AS VARCHAR), NULL, CAST(p_partkey % 2 AS VARCHAR), CAST(p_partkey AS VARCHAR)]) AS value FROM part WHERE p_partkey NOT IN (SELECT disk FROM have)""",
    "disk_profiles": "SELECT p_partkey AS disk, CAST(p_size AS BIGINT) AS size, p_brand AS unique_id, p_type AS serial, p_partkey AS \"offset\", CASE WHEN p_partkey % 2 = 0 THEN 'C' END AS drive_letter, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS label FROM part WHERE p_partkey % 9 > 0",
    "profile_verdicts": f"SELECT CASE WHEN page_id % 13 = 0 THEN 'fingerprint_differs' ELSE {listed(VERDICTS, 'page_id')} END AS verdict, count(*) AS n FROM pages GROUP BY ALL",
    "zip_members": "SELECT CAST(page_id AS VARCHAR) AS path, CAST(0 AS BIGINT) AS member_index, 'm/' || page_id AS member_path, 0 AS is_dir, CAST(strlen(coalesce(html, '')) AS BIGINT) AS size_bytes, 'deflate' AS method, 'unix' AS host_os, 0 AS flag_bits, 0 AS encrypted, 20 AS extract_version, CAST(0 AS BIGINT) AS header_offset, '2024-03-05 06:07:08' AS modified_raw FROM pages",
    "format_verdicts": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'invalid' WHEN 1 THEN 'unsupported' ELSE 'valid' END AS zip, CASE WHEN page_id % 2 = 0 THEN 'valid' ELSE 'invalid' END AS pdf FROM pages",
    "journal_events": "SELECT role AS event, count(*) AS n FROM conversations GROUP BY role",
    "decode_records": f"""WITH r AS (SELECT user_id, event_id, {listed(["valid", "unsupported", "odd", "invalid"], "event_id")} AS st, event_id % 3 AS w, event_id % 6 = 1 AS p FROM events) SELECT user_id AS entry, max(event_id) AS sequence, arg_max(st, event_id) AS status FROM r WHERE st <> 'odd' AND (st <> 'valid' OR w > 0) AND (st NOT IN ('valid', 'unsupported') OR NOT p) GROUP BY user_id""",
    "listed_tree": """WITH d AS (SELECT DISTINCT source, lang FROM documents) SELECT 'r' AS root_label, '' AS rel_path, 'ok' AS enum_status, CAST(0 AS BIGINT) AS texts UNION ALL SELECT 'gone', '', 'io_error', 0 UNION ALL SELECT DISTINCT 'r', 'source=' || source, 'ok', 0 FROM d UNION ALL SELECT 'r', 'source=' || source || '/lang=' || lang, 'ok', 1 FROM d""",
    "tree_digests": """WITH f AS (SELECT 'source=' || source || '/lang=' || lang AS folder, sha256(string_agg(regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') || chr(10), '' ORDER BY doc_id)) AS h FROM documents GROUP BY source, lang) SELECT folder, h AS hash_hex, 'valid' AS status, h AS stored, h AS streamed FROM f""",
    "photo_formats": f"""WITH {PHOTOS} SELECT i AS entry, CASE WHEN dng AND i % 4 = 1 THEN i + 1 WHEN dng THEN CAST('1' || i AS BIGINT) ELSE CAST('2' || i AS BIGINT) END AS width, CAST(CASE WHEN dng THEN 14 ELSE 8 END AS BIGINT) AS bit_depth, CASE WHEN NOT (la = 0 AND lo = 0) THEN la END AS gps_latitude, CASE WHEN NOT (la = 0 AND lo = 0) THEN lo END AS gps_longitude,
        'ExifIFD:DateTimeOriginal|offset=' || CASE WHEN i % 3 = 0 THEN 'embedded' ELSE 'XMP-xmp:CreateDate' END AS capture_time_source, CASE WHEN i % 3 = 0 THEN 120 ELSE 60 END AS capture_tz_offset_min, CASE WHEN i % 3 = 0 THEN '2024-01-02T01:04:05Z' ELSE '2024-01-02T02:04:05Z' END AS capture_time_utc, CASE WHEN i % 5 > 0 THEN (i % 5)::DOUBLE END AS focal_length_mm FROM p""",
    "photo_findings": f"""WITH {PHOTOS} SELECT i AS entry, 'invalid_nonpositive_focal_length' AS diagnostic_code, 'focal_length_mm' AS field_name, '0' AS raw_value, '{_said("invalid_nonpositive_focal_length")}' AS message FROM p WHERE i % 5 = 0
        UNION ALL SELECT i, 'invalid_zero_gps_placeholder', 'gps_latitude', '{{"latitude":"0 deg 0'' 0.00\\" N","longitude":"0 deg 0'' 0.00\\" N","altitude":null}}', '{_said("invalid_zero_gps_placeholder")}' FROM p WHERE la = 0 AND lo = 0""",
    "working_metadata": """SELECT doc_id AS entry, CASE WHEN doc_id % 2 = 1 THEN 'dng' ELSE 'cr3' END AS file_variant, 'S' AS creator_app, CASE WHEN doc_id % 2 = 0 THEN 'RGB' ELSE 'CMYK' END AS color_mode, doc_id % 4 * 8 AS bit_depth, doc_id AS width, CAST(7 AS BIGINT) AS height, doc_id % 3 AS layer_count, '["a, b"]' AS layer_names, 1 AS has_thumbnail FROM documents""",
    "document_metadata": """SELECT doc_id AS entry, CASE WHEN doc_id % 2 = 1 THEN 'dng' ELSE 'cr3' END AS doc_format, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'C' END AS author, CAST(NULL AS VARCHAR) AS last_modified_by, CAST(NULL AS VARCHAR) AS creator_app, '2020:01:01 00:00:00' AS created_prop_raw, CAST(NULL AS VARCHAR) AS modified_prop_raw, doc_id % 9 AS page_count, 1 AS is_encrypted FROM documents""",
    "film_metadata": """SELECT doc_id AS entry, 'mov' AS container_format, (doc_id % 5) + 0.5::DOUBLE AS duration_seconds, doc_id AS bit_rate, CAST(1 AS BIGINT) AS stream_count, CAST(NULL AS VARCHAR) AS timecode, CASE WHEN doc_id % 4 = 0 THEN '2023:01:01 00:00:00+00:00' ELSE '2024-02-03T04:05:06Z' END AS capture_time_raw, CASE WHEN doc_id % 4 = 0 THEN 'QuickTime:CreateDate|offset=embedded' ELSE 'format:creation_time' END AS capture_time_source,
        CASE WHEN doc_id % 4 = 0 THEN '2023-01-01T00:00:00Z' ELSE '2024-02-03T04:05:06Z' END AS capture_time_utc, CASE WHEN doc_id % 5 = 0 THEN 'M' WHEN doc_id % 5 = 1 THEN 'DJI' END AS camera_make, CASE WHEN doc_id % 5 = 1 THEN 'FC1' END AS camera_model, 'T' || doc_id AS title, 'W' AS author FROM documents""",
    "audio_streams": """SELECT doc_id AS entry, CAST(0 AS BIGINT) AS stream_index, 'c' AS codec_name, (doc_id % 5)::DOUBLE AS duration_seconds, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS BIGINT) AS channels FROM documents WHERE doc_id % 3 = 1
        UNION ALL SELECT doc_id, 0, 'aac', 2.5::DOUBLE, CASE WHEN doc_id % 4 = 0 THEN 48000 END, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 2 = 0""",
    "audio_faults": """SELECT entry, 'error' AS severity, code AS diagnostic_code FROM (SELECT doc_id AS entry, CASE WHEN doc_id % 3 = 0 THEN 'media_no_streams' WHEN doc_id % 2 = 0 AND doc_id % 3 = 2 THEN 'audio_stream_missing' END AS code FROM documents) WHERE code IS NOT NULL""",
    "routed_metadata": f"""WITH b AS (SELECT doc_id AS i, {listed(["photo", "photo", "archive", "document", "document", "document", "working", "photo", "archive", "none", "audio_video", "audio_video"])} AS route, doc_id % 5 > 0 AS t, doc_id % 7 > 0 AS f FROM documents), r AS (SELECT *, CASE WHEN route = 'audio_video' THEN t OR f WHEN route IN ('photo', 'working', 'document') THEN t ELSE false END AS done FROM b)
        SELECT route AS what, 'rows' AS status, count(*) AS n FROM r WHERE done GROUP BY ALL UNION ALL SELECT 'meta_status', CASE WHEN done THEN 'done' ELSE 'skipped' END, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'errors', 'c', count(*) FROM b WHERE i % 2 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'outcomes', CASE i % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'not_applicable' ELSE 'timeout' END, count(*) FROM b GROUP BY ALL""",
    "canonical_payloads": f"WITH b AS (SELECT doc_id AS i FROM documents), p AS (SELECT i, {_film} AS text FROM b) SELECT i AS entry, 'streams' AS provider, sha256(text) AS payload_sha256, strlen(text) AS uncompressed_bytes FROM p",
}
