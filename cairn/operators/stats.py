"""Read performance: outliers among comparable files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import size_band, throughput, timeout_for_size

from .ranking import latest_by, ranked

# What makes a group and an outlier.
GROUP_LEAST, BYTES_LEAST, STALL_SECONDS, MAD_SCALE = 8, 1 << 20, 30, 1.4826


def comparable_reads(performance: DataFrame, attempts: DataFrame, entries: DataFrame, roots: DataFrame, hashes: DataFrame) -> DataFrame:
    """Reads that may be held against each other, as ``outliers`` takes them: computed and complete, of the latest successful attempt at a hash that is valid.

    The group is the volume (the root where it is unknown), the type (by extension,
    else by kind) and the size band. performance: id, entry, attempt_number, origin,
    size, bytes_read, seconds, longest_stall; attempts: entry, stage, attempt_number,
    status; entries: entry, root_label, extension, media_kind, hash_status; roots:
    root_label, volume_serial; hashes: entry, origin, status.
    """
    last = latest_by(attempts.where("stage = 'hash'"), ["entry"], "attempt_number").where("status = 'succeeded'").select("entry", "attempt_number")
    sound = entries.where("hash_status = 'done'").join(hashes.where("origin = 'computed' and status = 'valid'").select("entry"), "entry", "left_semi").join(roots, "root_label")
    read = performance.where("origin = 'computed' and bytes_read >= size").join(last, ["entry", "attempt_number"], "left_semi").join(sound, "entry")
    known = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    volume = F.coalesce(known(F.col("volume_serial")), F.concat(F.lit("root:"), "root_label"))
    kind = F.coalesce(F.concat(F.lit("ext:"), F.lower(known(F.col("extension")))), F.concat(F.lit("kind:"), F.lower(F.coalesce(known(F.col("media_kind")), F.lit("other")))))
    return read.select("id", F.concat_ws("/", volume, kind, size_band(F.col("size")).cast("string")).alias("group"), "size", "bytes_read", "seconds", "longest_stall")


def group_medians(rows: DataFrame, key: str, value: str, unique: str) -> DataFrame:
    """key, n, median and mad (median of absolute deviations) of each group, exactly; ``unique`` tells a group's rows apart.

    Middle values are found by rank, so that a group of any size is sorted over as
    many tasks as it needs.
    """

    def middle(df: DataFrame, column: str) -> DataFrame:
        placed = ranked(df.select(key, column, unique), key, [column, unique], "_rank").join(df.groupBy(key).agg(F.count("*").alias("n")), key)
        return placed.where((2 * F.col("_rank")).between(F.col("n"), F.col("n") + 2)).groupBy(key, "n").agg((F.min(column) + (F.max(column) - F.min(column)) * 0.5).alias("median"))

    found = middle(rows, value)
    off = rows.join(found.select(key, "median"), key).select(key, unique, F.abs(F.col(value) - F.col("median")).alias("_off"))
    return found.join(middle(off, "_off").select(key, F.col("median").alias("mad")), key)


def outliers(rows: DataFrame) -> DataFrame:
    """Confidence that a read was slow. rows: id, group, size, bytes_read, seconds, longest_stall.

    A read is held against its group of at least GROUP_LEAST reads of BYTES_LEAST
    or more: by its share of the median where the deviation is 0, else by the
    robust score. Long stalls count on their own; the higher confidence wins.
    """
    read = rows.withColumn("rate", throughput(F.col("bytes_read"), F.col("seconds")))
    fit = read.where((F.col("size") >= BYTES_LEAST) & (F.col("rate") > 0))
    groups = group_medians(fit, "group", "rate", "id").where((F.col("n") >= GROUP_LEAST) & (F.col("median") > 0))
    both = read.join(groups, "group", "left")
    comparable = (F.col("size") >= BYTES_LEAST) & (F.col("rate") > 0) & F.col("median").isNotNull()
    ratio = F.try_divide(F.col("rate"), F.col("median"))
    score = F.try_divide(F.col("median") - F.col("rate"), MAD_SCALE * F.col("mad"))
    by_group = F.when(~comparable, 0).when(F.col("mad") == 0, F.when(ratio <= 0.25, 2).when(ratio <= 0.5, 1).otherwise(0)).when((score >= 6) & (ratio <= 0.5), 2).when((score >= 3.5) & (ratio <= 0.75), 1).otherwise(0)
    by_stall = F.when(F.col("longest_stall") <= 0, 0).when(F.col("longest_stall") >= timeout_for_size(F.col("size")), 2).when(F.col("longest_stall") >= STALL_SECONDS, 1).otherwise(0)
    rank = F.greatest(by_group, by_stall)
    reason = F.concat_ws(",", F.when(by_group > 0, "slow_in_group"), F.when(by_stall > 0, "stalled"))
    return both.select("id", "group", "rate", F.element_at(F.array(*map(F.lit, ("none", "low", "high"))), rank + 1).alias("confidence"), F.when(rank > 0, reason).alias("reason"))
