"""Ranks within groups of any size, and samples made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.sources.storage import stored

#: Rows of a group that one task may sort; larger groups are ranked in pieces.
GROUP_ROWS = 200_000


def latest_by(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of each key with the largest ``by``: one aggregate with partial sums, so hot keys do no harm."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "rank") -> DataFrame:
    """Number the rows of each key from 1 in ``order``, which must tell all rows apart.

    Ordinary keys are ranked by a window. Keys of more than GROUP_ROWS rows are
    sorted by range over all tasks and ranked in each range, behind the number of
    rows in the ranges before.
    """
    window = Window.partitionBy(key).orderBy(*order)
    hot = stored(df.groupBy(key).count().where(F.col("count") > GROUP_ROWS).select(key), "hot")
    if hot.isEmpty():
        return df.withColumn(rank, F.row_number().over(window).cast("long"))
    plain = df.join(hot, key, "left_anti").withColumn(rank, F.row_number().over(window).cast("long")).select(*df.columns, rank)
    pieces = stored(df.join(hot, key, "left_semi").repartitionByRange(key, *order).withColumn("_piece", F.spark_partition_id()), "pieces")
    before = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy(key, "_piece").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = pieces.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_piece").orderBy(*order)))
    far = inside.join(offsets, [key, "_piece"]).withColumn(rank, (F.col("_n") + F.col("_before")).cast("long"))
    return plain.unionByName(far.select(*df.columns, rank))


def running(df: DataFrame, key: str, place: str, step: Column, total: str, peak: str | None = None) -> DataFrame:
    """Add ``total``, the sum of ``step`` over the rows of a key up to a row, and ``peak``, the largest such sum of the rows before it (0 at least).

    ``place`` numbers the rows of a key 1, 2, 3, ... (as ``ranked`` does). Runs of
    GROUP_ROWS places are summed by themselves: the sum and the largest partial sum
    of a run say what the runs behind it start from. So no task gets a whole key.
    """
    rows = df.withColumn("_run", F.floor((F.col(place) - 1) / GROUP_ROWS)).withColumn("_step", step)
    inside = Window.partitionBy(key, "_run").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_step").over(inside))
    runs = rows.groupBy(key, "_run").agg(F.sum("_step").alias("_all"), F.max("_sum").alias("_top"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_start", F.coalesce(F.sum("_all").over(before), F.lit(0)))
    runs = runs.withColumn("_past", F.greatest(F.lit(0), F.max(F.col("_start") + F.col("_top")).over(before))).select(key, "_run", "_start", "_past")
    out = rows.join(runs, [key, "_run"]).withColumn(total, F.col("_sum") + F.col("_start"))
    if peak:
        out = out.withColumn(peak, F.greatest("_past", F.max(total).over(inside.rowsBetween(Window.unboundedPreceding, -1))))
    return out.select(*df.columns, total, *([peak] if peak else []))


def stratified_sample(df: DataFrame, size: str, key: str, percent: float, least: int, seed: str) -> DataFrame:
    """A sample that is the same for the same seed, spread over four strata of ``size``.

    It has max(least, ceil(n * percent / 100)) rows, or all n; strata are the
    quarters of the rows by (size, key), each gives a fourth (the first ones one
    more where k isn't divisible), in the order of sha2(seed, key), and a stratum
    that is too short is made up for by the others in that order.
    """
    spark = df.sparkSession
    n = df.count()
    k = min(n, max(least, -(-n * percent // 100))) if n else 0
    if k >= n:
        return df
    k = int(k)
    order = ranked(df.withColumn("_all", F.lit(0)), "_all", [size, key], "_place").drop("_all")
    bounds = [round(i * n / 4) for i in range(5)]
    stratum = sum((F.when(F.col("_place") > b, 1).otherwise(0) for b in bounds[1:4]), F.lit(0))
    picked = order.withColumn("_stratum", stratum).withColumn("_draw", F.sha2(F.concat_ws("‖", F.lit(seed), F.col(key).cast("string")), 256))
    drawn = ranked(picked, "_stratum", ["_draw", key], "_turn")
    quota = F.lit(k // 4) + F.when(F.col("_stratum") < k % 4, 1).otherwise(0)
    first = drawn.withColumn("_first", F.col("_turn") <= quota)
    # Those in the quota of their stratum come first, then the rest by draw, until there are k.
    every = ranked(first.withColumn("_all", F.lit(0)).withColumn("_late", (~F.col("_first")).cast("int")), "_all", ["_late", "_draw", key], "_final")
    return every.where(F.col("_final") <= k).select(*df.columns)
