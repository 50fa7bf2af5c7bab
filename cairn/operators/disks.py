"""A fleet of disks: layout, usage, health and critical attributes from recorded profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import clean, unique_nonempty

# Critical attribute ids in the order of reports, and those of which any raw count is worth a look.
CRITICAL = [5, 10, 184, 187, 188, 196, 197, 198, 199, 200]
RAW_COUNTS = [5, 10, 184, 187, 188, 196, 197, 198, 199]


def volume_usage(volumes: DataFrame) -> DataFrame:
    """Adds used_bytes, used_percent (four digits) and a normalised drive_letter; null unless size >= size_remaining >= 0."""
    ok = (F.col("size") >= F.col("size_remaining")) & (F.col("size_remaining") >= 0)
    used = F.when(ok, F.col("size") - F.col("size_remaining"))
    letter = F.regexp_replace(F.upper(clean(F.col("drive_letter"))), ":+$", "")
    return volumes.withColumn("used_bytes", used).withColumn("used_percent", F.bround(F.try_divide(used * 100.0, F.nullif(F.col("size"), F.lit(0)).cast("double")), 4)).withColumn("drive_letter", F.when(letter != "", F.concat(letter, F.lit(":"))))


def layout_gaps(partitions: DataFrame, disks: DataFrame) -> DataFrame:
    """disk, kind, offset and size of space that no partition covers. partitions: disk, offset, size; disks: disk, size.

    Partitions without a valid offset and size are skipped, disks without a size
    have no gaps. A disk has few partitions, so its window is small.
    """
    sound = disks.where("size > 0").select("disk", F.col("size").alias("disk_size"))
    parts = partitions.where("offset >= 0 and size >= 0").select("disk", "offset", (F.col("offset") + F.col("size")).alias("end"))
    before = Window.partitionBy("disk").orderBy("offset", "end").rowsBetween(Window.unboundedPreceding, -1)
    cursor = F.coalesce(F.max("end").over(before), F.lit(0))
    inner = parts.withColumn("cursor", cursor).where("offset > cursor").join(sound, "disk").select("disk", F.when(F.col("cursor") == 0, "leading").otherwise("inter_partition").alias("kind"), F.col("cursor").alias("offset"), (F.col("offset") - F.col("cursor")).alias("size"))
    last = sound.join(parts.groupBy("disk").agg(F.max("end").alias("end")), "disk", "left").withColumn("end", F.coalesce("end", F.lit(0)))
    return inner.unionByName(last.where("end < disk_size").select("disk", F.lit("trailing").alias("kind"), F.col("end").alias("offset"), (F.col("disk_size") - F.col("end")).alias("size")))


def critical_smart(attributes: DataFrame) -> DataFrame:
    """disk, place (order of the report), id, raw and status of critical attributes. attributes: disk, id, when_failed, raw."""
    place = F.array_position(F.array(*map(F.lit, CRITICAL)), F.col("id").cast("int"))
    status = F.when(clean(F.col("when_failed")) != "", "failed").when(F.col("id").isin(RAW_COUNTS) & (F.col("raw") > 0), "attention").otherwise("ok")
    return attributes.where(F.col("id").isin(CRITICAL)).select("disk", place.alias("place"), "id", "raw", status.alias("status"))


#: What an NVMe disk reports in place of attributes, in the order of reports.
NVME = ["critical_warning", "available_spare", "available_spare_threshold", "percentage_used", "unsafe_shutdowns", "media_errors", "num_err_log_entries"]


def nvme_fields(logs: DataFrame, attributes: DataFrame) -> DataFrame:
    """disk, place, field and value of the health log (a row a disk with NVME columns) of disks that give no critical attribute."""
    alone = logs.join(critical_smart(attributes).select("disk").distinct(), "disk", "left_anti")
    shown = lambda f: F.concat(F.lit("0x"), F.lpad(F.hex(F.col(f).cast("long")), 2, "0")) if f == "critical_warning" else F.col(f).cast("string")
    fields = F.array(*[F.struct(F.lit(k).cast("long").alias("place"), F.lit(f).alias("field"), shown(f).alias("value")) for k, f in enumerate(NVME, 1)])
    return alone.select("disk", F.explode(fields).alias("x")).select("disk", "x.*")


def health(passed: Column, critical_warning: Column) -> Column:
    """passed, failed, warning or unknown, from the overall verdict or, without one, the warning bits."""
    return F.when(passed, "passed").when(~passed, "failed").when(critical_warning == 0, "passed").when(critical_warning.isNotNull(), "warning").otherwise("unknown")


def disk_labels(partitions: DataFrame) -> DataFrame:
    """disk with its distinct letters and labels in order of offset."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "drive_letter", "label")))
    names = lambda f: unique_nonempty(F.transform("p", lambda x: x[f]))
    return partitions.groupBy("disk").agg(ordered.alias("p")).select("disk", names("drive_letter").alias("letters"), names("label").alias("labels"))


def match_targets(disks: DataFrame, devices: DataFrame) -> DataFrame:
    """Disks and devices by disk number: the first device of several with a warning; what matches nothing stays."""
    first = devices.groupBy("disk").agg(F.min("device").alias("device"), (F.count("*") > 1).alias("several"))
    both = disks.select("disk", F.lit(True).alias("_d")).join(first, "disk", "full_outer")
    return both.select("disk", "device", F.when(F.col("_d").isNull(), "no_disk").when(F.col("device").isNull(), "no_device").when(F.col("several"), "several_devices").otherwise("matched").alias("status"))


def same_disk(before: DataFrame, after: DataFrame) -> DataFrame:
    """disk and what differs between two inventories (disk, size, unique_id, serial)."""
    facts = ["size", "unique_id", "serial"]
    both = before.select("disk", F.struct(*facts).alias("a")).join(after.select("disk", F.struct(*facts).alias("b")), "disk", "full_outer")
    drift = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in facts]))
    return both.select("disk", F.when(F.col("a").isNull(), F.array(F.lit("new"))).when(F.col("b").isNull(), F.array(F.lit("gone"))).otherwise(drift).alias("drift"))


def disk_summary(disks: DataFrame, partitions: DataFrame, gaps: DataFrame, smart: DataFrame) -> DataFrame:
    """One row a disk: health, letters and labels, partitions, covered and gap bytes, attributes that failed or want attention. disks: disk, size, passed, critical_warning; partitions: disk, offset, size, drive_letter, label."""
    parts = partitions.groupBy("disk").agg(F.count("*").alias("partitions"), F.sum("size").alias("partition_bytes"))
    free = gaps.groupBy("disk").agg(F.sum("size").alias("gap_bytes"))
    bad = smart.groupBy("disk").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "attention").alias("attention"))
    own = disks.select("disk", "size", health(F.col("passed"), F.col("critical_warning")).alias("health"))
    for more in (disk_labels(partitions), parts, free, bad):
        own = own.join(more, "disk", "left")
    return own.na.fill(0, ["partitions", "partition_bytes", "gap_bytes", "failed", "attention"])
