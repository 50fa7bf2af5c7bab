"""Snapshots as folders of Parquet tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import issues
from cairn.operators.ranking import ranked

from .files import file_digests
from .schemas import CHECKS, COMPARISON, EVIDENCE, KEYS, REFERENCES, TABLES
from .storage import stored

Bundle = dict[str, DataFrame]
#: Tables of a snapshot that lie by root, so that what changes in one root is written alone.
PARTED = ("dirs", "entries", "hashes", "raw_payloads", "metadata_diagnostics", "errors", "entry_attempts", "read_performance", "format_checks")
MANIFEST = "table string, files bigint, bytes bigint, digest string"


def stored_tables(spark: SparkSession, path: str) -> DataFrame:
    """table, files, bytes and digest that a folder's manifest declares."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def check_folder(spark: SparkSession, path: str) -> list[str]:
    """The tables of a folder whose files aren't as its manifest declares."""
    now = _described(spark, path, [r.table for r in stored_tables(spark, path).collect()])  # a row a table
    return sorted(r.table for r in stored_tables(spark, path).exceptAll(now).select("table").distinct().collect())


def _described(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """table, files, bytes and digest of each of a folder's tables, as ``directory_digest`` gives them, from one listing of the folder."""
    fs, where = _file_system(spark, path)
    inside = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/", "")
    depth = fs.makeQualified(where).depth()
    each = file_digests(spark, path, "*.parquet").select(F.split_part(inside, F.lit("/"), F.lit(depth + 1)).alias("table"), "bytes", "sha256")
    names = spark.createDataFrame([(t,) for t in tables], "table string")
    return names.join(_digests_together(each, ["table"]), "table", "left").select("table", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "digest")


def fingerprint(spark: SparkSession, path: str) -> str:
    """Eight hexadecimal digits that stand for what a folder's manifest declares; they end the folder's name."""
    rows = stored_tables(spark, path).agg(F.upper(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "table", "files", "bytes", "digest"))), "\n"), 256), 1, 8)))
    return rows.first()[0]


def _file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def published_as(spark: SparkSession, path: str) -> list[str]:
    """The folders that ``path`` was published as: its name and a fingerprint."""
    fs, _ = _file_system(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}_" + "[0-9A-F]" * 8)) or []
    return sorted(str(x.getPath()) for x in found)


def clear_partial(spark: SparkSession, path: str) -> int:
    """Delete what tries to publish ``path`` have left that were cut off with their driver; none may be running. Returns how many there were."""
    fs, _ = _file_system(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.partial-*")) or []
    for x in found:
        fs.delete(x.getPath(), True)
    return len(found)


def _publish(tables: Bundle, path: str, parted: tuple[str, ...] = ()) -> str:
    """Write tables and their manifest to a folder of this try, then give it its name, which ends in the manifest's fingerprint, by one rename.

    A try that fails deletes its folder; one that is cut off leaves a folder that no later try meets (see ``clear_partial``).
    """
    spark = next(iter(tables.values())).sparkSession
    if there := published_as(spark, path):
        raise FileExistsError(f"{there[0]} exists")
    partial = f"{path}.partial-{uuid.uuid4().hex}"
    fs, source = _file_system(spark, partial)
    try:
        for name, df in tables.items():
            # Rows of a root are brought together first (large roots stay in several parts): otherwise every task writes a file a root.
            (df.hint("rebalance", "root_label").write.partitionBy("root_label") if name in parted else df.write).parquet(f"{partial}/{name}")
        _described(spark, partial, list(tables)).write.parquet(f"{partial}/manifest")
        final = f"{path}_{fingerprint(spark, partial)}"
        if not fs.rename(source, _file_system(spark, final)[1]):
            raise FileExistsError(f"{final} can't be given its name")
    except BaseException:
        fs.delete(source, True)
        raise
    return final


def _read(spark: SparkSession, path: str, schemas: dict[str, str], info: str, wanted: list[str] | None, verify: bool) -> Bundle:
    have = [r.table for r in stored_tables(spark, path).collect()]  # a row a table
    if info not in have or spark.read.schema(schemas[info]).parquet(f"{path}/{info}").where("status = 'complete'").isEmpty():
        raise ValueError(f"{path} isn't sealed")
    if missing := sorted(set(wanted or []) - set(have)):
        raise ValueError(f"{path} has no {missing}")
    if verify and not path.rstrip("/").endswith("_" + fingerprint(spark, path)):
        raise ValueError(f"{path}: its name isn't the fingerprint of its manifest")
    if verify and (bad := check_folder(spark, path)):
        raise ValueError(f"{path}: {bad} aren't as the manifest declares")
    return {t: spark.read.schema(schemas[t]).parquet(f"{path}/{t}") for t in [info, *(wanted or [t for t in have if t not in EVIDENCE])]}


def read_snapshot(spark: SparkSession, path: str, tables: list[str] | None = None, verify: bool = False) -> Bundle:
    """The tables of a snapshot's folder, each with its schema; a folder without a seal is refused. ``verify`` reads all files and holds them against the manifest, and that against the folder's name."""
    return _read(spark, path, TABLES, "snapshot_info", tables, verify)


def read_evidence(spark: SparkSession, path: str) -> Bundle:
    """What a published folder says of its own making: snapshot_manifest (one JSON document) and run_events."""
    return {t: spark.read.schema(kind).parquet(f"{path}/{t}") for t, kind in EVIDENCE.items()}


def evidence(bundle: Bundle, stem: str, events: DataFrame | None = None, document: dict | None = None) -> Bundle:
    """snapshot_manifest and run_events of a described bundle that is to be published.

    events: value (a line of JSON) and event, as ``journals.read_journal`` gives
    them; they are numbered by their time and text, and the seal is the last one.
    document: what the caller's own manifest says besides.
    """
    spark = bundle["snapshot_info"].sparkSession
    if events is None:
        events = spark.createDataFrame([], "value string, event string")
    said = F.from_json("value", "map<string,variant>")
    stamp = F.try_variant_get(F.try_element_at(said, F.lit("ts")), "$", "string")
    told = events.select(stamp.alias("occurred_at_utc"), "event", F.to_json(F.map_filter(said, lambda k, v: ~k.isin("ts", "event"))).alias("payload_json"))
    # Equal lines are told apart, so that each has a number.
    told = ranked(told.withColumn("_all", F.lit(0)).withColumn("_id", F.monotonically_increasing_id()), "_all", ["occurred_at_utc", "event", "payload_json", "_id"], "event_seq").drop("_all", "_id")
    told = stored(told, "run-events")
    info = bundle["snapshot_info"]
    n = told.count()
    name = stem.rstrip("/").rsplit("/", 1)[-1]
    naming = {"snapshot_stem": name, "filename_pattern": f"{name}_<first 8 hex digits of the manifest's SHA-256, upper case>"}
    seal = info.select(F.lit(n + 1).cast("long").alias("event_seq"), F.col("finished_at_utc").alias("occurred_at_utc"), F.lit("snapshot_sealed").alias("event"), F.lit(json.dumps(naming)).alias("payload_json"))
    labels = bundle["roots"].agg(F.array_sort(F.collect_list("root_label")).alias("labels"))  # roots: a few
    fields = ["snapshot_uuid", "schema_version", "tool_version", "started_at_utc", "finished_at_utc", "path_key_rule", "hash_coverage", "has_file_issues", "has_unstable", "has_gaps"]
    counts = F.from_json("counts_json", "map<string,bigint>")
    made = info.join(labels, F.lit(True)).select(
        F.to_json(F.struct(
            F.lit(1).alias("manifest_version"), *fields, F.col("labels").alias("root_labels"), counts.alias("counts"), F.struct(F.lit(n + 1).alias("count"), F.lit("run_events").alias("table")).alias("events"),
            F.struct(F.lit("sha256").alias("algorithm"), F.lit(32).alias("bits_in_name")).alias("integrity"), *[F.lit(v).alias(k) for k, v in naming.items()], F.lit(json.dumps(document or {})).alias("run"),
        )).alias("manifest_json"), F.col("finished_at_utc").alias("embedded_at_utc"),
    )
    return {"snapshot_manifest": made, "run_events": told.select(*seal.columns).unionByName(seal)}


def described(bundle: Bundle) -> Bundle:
    """The bundle whose snapshot_info declares its flags and counts (JSON by section and key)."""
    errors = bundle["errors"] if "errors" in bundle else bundle["entries"].select(F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("message")).where("false")
    found = issues.flags(bundle["entries"], bundle["dirs"], bundle["roots"], errors)
    diagnostics = bundle["metadata_diagnostics"] if "metadata_diagnostics" in bundle else errors.select(F.lit("").alias("severity"))
    counted = issues.snapshot_counts(bundle["entries"].withColumnRenamed("size_bytes", "size"), bundle["dirs"], bundle["roots"], errors, diagnostics)
    text = counted.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(".", "section", "key").alias("key"), "value"))))).alias("counts_json"))  # a few rows by kind and status
    flags = ["has_file_issues", "has_unstable", "has_gaps"]
    info = bundle["snapshot_info"].drop(*flags, "counts_json").join(found.select(*[F.col(f).cast("int").alias(f) for f in flags]), F.lit(True)).join(text, F.lit(True))
    return bundle | {"snapshot_info": info.select(*bundle["snapshot_info"].columns)}


def publish_snapshot(bundle: Bundle, path: str, events: DataFrame | None = None, document: dict | None = None) -> str:
    """Write a snapshot that the seal gate lets pass, with its manifest and events, and return the folder: ``path`` and a fingerprint.

    A name is published once. The folder is complete when it gets its name (on stores that rename in one step; elsewhere the manifest tells).
    """
    gate = seal_gate(bundle).first()
    if any(gate.asDict().values()):
        raise ValueError(f"not ready: {gate.asDict()}")
    return _publish(bundle | evidence(bundle, path, events, document), path, PARTED)


def publish_comparison(found: Bundle, info: DataFrame, path: str) -> str:
    """Write a comparison (entries, groups, dirs, subtrees) and its diff_info, and return the folder: ``path`` and a fingerprint."""
    return _publish(found | {"diff_info": info}, path)


def read_comparison(spark: SparkSession, path: str, verify: bool = False) -> Bundle:
    """The tables of a stored comparison; a folder without a seal is refused."""
    return _read(spark, path, COMPARISON, "diff_info", None, verify)


def seal_check(bundle: Bundle, damaged: list[str] = ()) -> DataFrame:
    """One row: whether a snapshot is complete, whole (``damaged``: tables that aren't as declared), and its flags are what its rows say."""
    again = described(bundle)["snapshot_info"]
    flags = ["has_file_issues", "has_unstable", "has_gaps"]
    found = bundle["snapshot_info"].select((F.col("status") == "complete").alias("complete"), *flags, "counts_json").join(again.select(*[F.col(f).alias(f"_{f}") for f in flags], F.col("counts_json").alias("_counts")), F.lit(True))
    same = F.lit(True)
    for f in flags:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return found.select("complete", F.lit(not damaged).alias("whole"), same.alias("flags_hold"), F.col("counts_json").eqNullSafe(F.col("_counts")).alias("counts_hold"))


def seal_gate(bundle: Bundle) -> DataFrame:
    """One row: what still stands against a seal: entries and format checks to do, attempts that run, stages that haven't ended."""
    busy = F.col("hash_status").isin("pending", "processing") | F.col("meta_status").isin("pending", "processing")
    gate = bundle["entries"].agg(F.count_if(busy).alias("pending_entries"))
    rules = {"running_attempts": ("entry_attempts", F.col("status") == "running"), "pending_checks": ("format_checks", F.col("status").isin("pending", "processing")), "open_stages": ("stage_checkpoints", ~F.col("state").isin("complete", "skipped", "failed"))}
    for name, (table, cond) in rules.items():
        one = bundle[table].agg(F.count_if(cond).alias(name)) if table in bundle else None
        gate = gate.join(one, F.lit(True)) if one is not None else gate.withColumn(name, F.lit(0).cast("long"))
    return gate


def constraint_violations(bundle: Bundle) -> DataFrame:
    """table, rule and number of rows that break it: conditions, keys and references."""
    out = None
    for name, df in bundle.items():
        rules = CHECKS.get(name, {})
        parts = []
        if rules:
            counted = df.agg(*[F.count_if(~F.expr(c)).alias(r) for r, c in rules.items()])
            parts.append(counted.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])).alias("x")).select("x.*"))
        if name in KEYS:
            parts.append(df.groupBy(*KEYS[name]).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("unique").alias("rule"), "n"))
        if name in REFERENCES and REFERENCES[name][1] in bundle:
            columns, other = REFERENCES[name]
            parts.append(df.join(bundle[other], columns, "left_anti").agg(F.count("*").alias("n")).select(F.lit(f"in {other}").alias("rule"), "n"))
        for part in parts:
            part = part.select(F.lit(name).alias("table"), "rule", "n")
            out = part if out is None else out.unionByName(part)
    return out


def capabilities(spark: SparkSession, found: dict[str, DataFrame | None], wanted: dict[str, list[str]], unavailable: dict[str, str] | None = None) -> DataFrame:
    """capability (a table), state and rows: unavailable without the table, incompatible without its columns, else available or empty.

    ``unavailable`` names what wasn't executed: no rows say nothing there. Counts are one job each.
    """
    out = []
    for name, columns in wanted.items():
        df = found.get(name)
        if df is None:
            out.append(spark.range(1).select(F.lit(name).alias("capability"), F.lit("unavailable").alias("state"), F.lit(None).cast("long").alias("n")))
        elif not set(columns) <= set(df.columns):
            out.append(spark.range(1).select(F.lit(name).alias("capability"), F.lit("incompatible").alias("state"), F.lit(None).cast("long").alias("n")))
        else:
            n = F.count("*")
            state = F.when(n > 0, "available").otherwise("unavailable" if name in (unavailable or {}) else "empty")
            out.append(df.agg(n.alias("n"), state.alias("state")).select(F.lit(name).alias("capability"), "state", F.when(F.col("state") != "unavailable", F.col("n")).alias("n")))
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def module_status(modules: DataFrame, capability: DataFrame) -> DataFrame:
    """module, the worst state that it needs, and its rows if all are known. modules: module, capability."""
    order = ["available", "empty", "unavailable", "incompatible", "invalid"]
    both = modules.join(capability, "capability", "left").na.fill("unavailable", ["state"])
    worst = F.max(F.array_position(F.array(*map(F.lit, order)), F.col("state")))
    return both.groupBy("module").agg(F.element_at(F.array(*map(F.lit, order)), worst.cast("int")).alias("state"), F.when(F.count_if(F.col("n").isNull()) == 0, F.sum("n")).alias("rows"))


def module_state_counts(status: DataFrame) -> DataFrame:
    """Modules by state (of ``module_status``), every state in its place, 0 included."""
    states = ["available", "empty", "unavailable", "incompatible", "invalid"]
    counted = status.agg(*[F.count_if(F.col("state") == x).alias(x) for x in states])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(x).alias("state"), F.col(x).alias("n")) for x in states])).alias("x")).select("x.*")


def _digests_together(each: DataFrame, keys: list[str]) -> DataFrame:
    """files, bytes and a digest over the digests of all files of a key, whatever their order.

    Digests are put together in parts by their first digits, so no task gathers more than a small share of them.
    """
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n").cast("binary"), 256)
    parts = each.groupBy(*keys, F.substring("sha256", 1, 3).alias("part")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), joined("sha256").alias("sha"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"), joined(F.concat("part", "sha")).alias("digest"))


def directory_digest(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row: files, bytes and a digest over the digests of all files below a folder, whatever their order."""
    whole = _digests_together(file_digests(spark, path, pattern), [])
    return whole.select(F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "digest")


def input_identity(spark: SparkSession, path: str) -> DataFrame:
    """One row that names what a folder holds: its files, bytes, digest and the latest change."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return directory_digest(spark, path, "*").join(listed.agg(F.max("modificationTime").alias("modified")), F.lit(True))


def input_unchanged(before: DataFrame, after: DataFrame) -> bool:
    return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
