"""Snapshots that are still being made: a folder of tables by root, of which a step writes only the roots that it touches.

Every step reads what is there, works out the rows of the touched roots, stores
them aside and then puts them in place of these roots' folders. A step that is cut
off is done again with the same input: what has been put in place already comes out unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import attempt_to_current
from cairn.operators.ranking import latest_by

from .bundle import PARTED, Bundle
from .schemas import KEYS, TABLES
from .storage import forget, stored

ENTRY = ["root_label", "rel_path"]
#: What a listing says of an entry and a new one may say otherwise; a change puts these statuses back to pending.
STATS, STATUSES = ["size_bytes", "modified_at_utc"], ["meta_status", "hash_status"]
#: Tables whose rows go with their entry.
OF_ENTRIES = ["hashes", "raw_payloads", "metadata_diagnostics", "errors", "entry_attempts", "read_performance", "format_checks"]
#: Statuses that an attempt ends with.
ENDED = ["succeeded", "failed", "timeout", "unstable", "skipped", "invalid", "unsupported", "tool_error", "cancelled", "abandoned"]
STAGES = {"hash": "hash_status", "metadata": "meta_status"}


def create(bundle: Bundle, path: str) -> None:
    """Write a bundle to a new folder that isn't sealed."""
    for name, df in bundle.items():
        if name == "snapshot_info":
            df = df.withColumn("status", F.lit("running"))
        (df.write.partitionBy("root_label") if name in PARTED else df.write).mode("errorifexists").parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, tables: list[str]) -> Bundle:
    return {t: spark.read.schema(TABLES[t]).parquet(f"{path}/{t}") for t in tables}


def has(spark: SparkSession, path: str, table: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def sealed(bundle: Bundle) -> Bundle:
    """The bundle as complete; ``bundle.publish_snapshot`` takes it."""
    return bundle | {"snapshot_info": bundle["snapshot_info"].withColumn("status", F.lit("complete"))}


def put(rows: DataFrame, path: str, table: str, roots: list[str]) -> None:
    """Write the rows of some roots (all that these have) in place of what is there. Other roots' files aren't touched; a root without rows loses its folder."""
    spark = rows.sparkSession
    names = [c.split(" ")[0] for c in TABLES[table].split(", ")]
    aside = stored(rows.where(F.col("root_label").isin(roots)).select(names), f"put-{table}")
    aside.write.partitionBy("root_label").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{table}")
    left = {r.root_label for r in aside.select("root_label").distinct().collect()}  # roots: a few
    for root in sorted(set(roots) - left):
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(root)
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/root_label={name}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    forget(aside)


def merged(recorded: DataFrame, listed: DataFrame, keys: list[str], stats: list[str], statuses: list[str]) -> DataFrame:
    """Whole rows after a new listing, and ``change``: inserted, updated, kept or removed (with their old values).

    A listed row gives its own columns; the others stay. Where ``stats`` differ, or the row is new, ``statuses`` are pending.
    """
    old = recorded.select(*keys, F.struct(*[c for c in recorded.columns if c not in keys]).alias("_old"))
    new = listed.select(*keys, F.struct(*[c for c in listed.columns if c not in keys]).alias("_new"))
    both = old.join(new, keys, "full_outer")
    same = F.lit(True)
    for c in stats:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
    gone, fresh = F.col("_new").isNull(), F.col("_old").isNull()
    change = F.when(fresh, "inserted").when(gone, "removed").when(same, "kept").otherwise("updated")

    def value(c: str) -> Column:
        before = F.col(f"_old.{c}")
        if c in statuses:
            return F.when(fresh | (~gone & ~same), "pending").otherwise(before)
        return F.when(gone, before).otherwise(F.col(f"_new.{c}")) if c in listed.columns else before

    return both.select(*keys, *[value(c).alias(c) for c in recorded.columns if c not in keys], change.alias("change"))


def reconcile(spark: SparkSession, path: str, listed: Bundle) -> DataFrame:
    """Bring dirs and entries of a working folder to a new listing of some roots (its own rows of dirs and entries, of every root that was listed).

    Vanished rows go, with what belongs to vanished entries; entries whose size
    or time changed are pending again. Roots in which nothing changed aren't
    written. Returns root_label, table, change and the number of rows.
    """
    now = read(spark, path, ["dirs", "entries"])
    roots = [r.root_label for r in listed["dirs"].select("root_label").union(listed["entries"].select("root_label")).distinct().collect()]  # a few
    counts, changed = None, {}
    for name, stats, statuses in (("dirs", ["enum_status"], []), ("entries", STATS, STATUSES)):
        known = now[name].where(F.col("root_label").isin(roots))
        changed[name] = stored(merged(known, listed[name], ENTRY, stats, statuses), f"merged-{name}")
        part = changed[name].groupBy("root_label", F.lit(name).alias("table"), "change").agg(F.count("*").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    counts = stored(counts, "changes")
    touched = {(r.table, r.root_label) for r in counts.where("change <> 'kept'").select("table", "root_label").distinct().collect()}
    # Entries last: a step that is cut off before finds the vanished ones again.
    removed = changed["entries"].where("change = 'removed'").select(ENTRY)
    losing = sorted({r.root_label for r in counts.where("table = 'entries' and change = 'removed'").select("root_label").collect()})
    for name in OF_ENTRIES:
        if losing and has(spark, path, name):
            put(read(spark, path, [name])[name].where(F.col("root_label").isin(losing)).join(removed, ENTRY, "left_anti"), path, name, losing)
    for name in ("dirs", "entries"):
        mine = sorted(root for table, root in touched if table == name)
        if mine:
            put(changed[name].where("change <> 'removed'").drop("change"), path, name, mine)
    forget(*changed.values())
    return counts


def finish_attempts(spark: SparkSession, path: str, finished: DataFrame) -> DataFrame:
    """Close running attempts of a working folder: their rows, the current status of their entries, format checks and read performance.

    finished: root_label, rel_path, attempt_id, status, ended_at_utc and, where
    known, bytes_read, end_reason, error_code, error_message, result_json,
    stat_match, detail and performance (a struct of columns of read_performance,
    null without any). Attempts that aren't running, aren't there, or are
    finished twice are refused, as are statuses that end nothing. Of
    several attempts of an entry and stage the one with the largest number
    decides. Only touched roots are written. Returns root_label, stage, current and the number of entries.
    """
    optional = {"bytes_read": "bigint", "end_reason": "string", "error_code": "string", "error_message": "string", "result_json": "string", "stat_match": "int", "detail": "string"}
    given = finished.select(*ENTRY, "attempt_id", F.col("status").alias("_status"), "ended_at_utc", *[(F.col(c) if c in finished.columns else F.lit(None)).cast(kind).alias(f"_{c}") for c, kind in optional.items()], *(["performance"] if "performance" in finished.columns else []))
    attempts = read(spark, path, ["entry_attempts"])["entry_attempts"]
    key = [*ENTRY, "attempt_id"]
    closing = stored(given.join(attempts.drop("ended_at_utc"), key, "left"), "closing")
    bad = closing.agg(F.count_if(~F.coalesce(F.col("status") == "running", F.lit(False))).alias("not_running"), F.count_if(~F.coalesce(F.col("_status").isin(ENDED), F.lit(False))).alias("no_end"), (F.count("*") - F.countDistinct(*key)).alias("twice")).first()
    if any(bad):
        raise ValueError(f"attempts can't be finished: {bad.asDict()}")
    roots = [r.root_label for r in closing.select("root_label").distinct().collect()]  # a few
    in_roots = F.col("root_label").isin(roots)
    current = closing.select(*ENTRY, "stage", "attempt_number", "attempt_id", "ended_at_utc", "_stat_match", "_detail", attempt_to_current(F.col("stage"), F.col("_status")).alias("current"))
    current = stored(latest_by(current, [*ENTRY, "stage"], "attempt_number"), "current")
    by_stage = current.groupBy(*ENTRY).agg(*[F.max(F.when(F.col("stage") == stage, F.col("current"))).alias(f"_{column}") for stage, column in STAGES.items()])
    entries = read(spark, path, ["entries"])["entries"].where(in_roots).join(by_stage, ENTRY, "left")
    put(entries.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in STAGES.values()}), path, "entries", roots)
    if has(spark, path, "format_checks"):
        done = current.where("stage = 'format'").select(*ENTRY, "attempt_id", F.col("current").alias("_now"), F.col("ended_at_utc").alias("_at"), "_stat_match", "_detail")
        checks = read(spark, path, ["format_checks"])["format_checks"].where(in_roots).join(done, key, "left")
        hit = F.col("_now").isNotNull()
        put(checks.withColumns({"status": F.coalesce("_now", "status"), **{c: F.when(hit, F.col(f)).otherwise(F.col(c)) for c, f in (("stat_match", "_stat_match"), ("detail", "_detail"), ("checked_at_utc", "_at"))}}), path, "format_checks", roots)
    if "performance" in finished.columns:
        fields = set(finished.schema["performance"].dataType.fieldNames())
        kinds = dict(c.split(" ") for c in TABLES["read_performance"].split(", "))
        own = {**{c: F.col(c) for c in (*key, "session_id", "stage")}, "recorded_at_utc": F.col("ended_at_utc")}
        fresh = closing.where("performance is not null").select(*[(own[c] if c in own else F.col(f"performance.{c}") if c in fields else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])
        before = read(spark, path, ["read_performance"])["read_performance"].where(in_roots).join(fresh.select(key), key, "left_anti") if has(spark, path, "read_performance") else fresh.where("false")
        put(before.unionByName(fresh), path, "read_performance", roots)
    # The attempts themselves last: until then a step that is cut off may be done again.
    ended = closing.select(*key, F.col("_status"), F.col("ended_at_utc").alias("_ended_at_utc"), *[f"_{c}" for c in optional if c not in ("stat_match", "detail")])
    rows = attempts.where(in_roots).join(ended, key, "left")
    hit = F.col("_status").isNotNull()
    values = {"status": F.coalesce("_status", "status"), "ended_at_utc": F.coalesce("_ended_at_utc", "ended_at_utc"), "bytes_read": F.coalesce("_bytes_read", "bytes_read"), **{c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("end_reason", "error_code", "error_message")}, "result_json": F.when(hit, F.coalesce("_result_json", F.lit("{}"))).otherwise(F.col("result_json"))}
    put(rows.withColumns(values), path, "entry_attempts", roots)
    counts = stored(current.groupBy("root_label", "stage", "current").agg(F.count("*").alias("n")), "finished")
    forget(closing, current)
    return counts


def recover(spark: SparkSession, path: str) -> dict[str, int]:
    """After a crash: running attempts are abandoned and entries in process are pending again, in the roots that have any. Returns how many of each."""
    found = read(spark, path, ["entries", "entry_attempts"])
    busy = F.lit(False)
    for c in STATUSES:
        busy = busy | F.coalesce(F.col(c) == "processing", F.lit(False))
    rules = {"entry_attempts": (F.col("status") == "running", {"status": F.when(F.col("status") == "running", "abandoned").otherwise(F.col("status"))}), "entries": (busy, {c: F.when(F.col(c) == "processing", "pending").otherwise(F.col(c)) for c in STATUSES})}
    out = {}
    for name, (hit, values) in rules.items():
        per = found[name].where(hit).groupBy("root_label").count().collect()  # roots: a few
        out[name] = sum(r["count"] for r in per)
        if per:
            roots = [r.root_label for r in per]
            put(found[name].where(F.col("root_label").isin(roots)).withColumns(values), path, name, roots)
    return out


def check_keys(spark: SparkSession, path: str, tables: list[str]) -> dict[str, int]:
    """How many keys of each table stand there twice."""
    return {t: read(spark, path, [t])[t].groupBy(*KEYS[t]).count().where("count > 1").count() for t in tables if t in KEYS}
