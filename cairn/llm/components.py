"""Connected components of links by contraction: no list of all links meets in one task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches), from links with columns a and b (long).

    Each round points every node at its smallest smaller neighbour, follows the
    pointers to their ends by doubling, and keeps the links between different
    ends, of which there are fewer each time. Nodes without links and roots
    themselves are left out.
    """
    left = stored(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    known: DataFrame | None = None
    while not left.isEmpty():
        to = stored(left.groupBy("hi").agg(F.min("lo").alias("lo")), "pointers")
        while True:
            next_ = to.select(F.col("hi").alias("lo"), F.col("lo").alias("far"))
            further = stored(to.select("hi", "lo").join(next_, "lo", "left").select("hi", F.coalesce("far", "lo").alias("lo"), F.col("far").isNotNull().alias("moved")), "pointers")
            forget(to)
            to = further
            if to.where("moved").isEmpty():
                break
        ends = to.select("hi", "lo")
        end = lambda side, ends=ends: ends.select(F.col("hi").alias(side), F.col("lo").alias(f"{side}_end"))
        moved = left.join(end("hi"), "hi", "left").join(end("lo"), "lo", "left").select(F.coalesce("hi_end", "hi").alias("a"), F.coalesce("lo_end", "lo").alias("b"))
        if known is None:
            found = ends.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        else:
            onward = ends.select(F.col("hi").alias("root"), F.col("lo").alias("far"))
            old = known.join(onward, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
            fresh = ends.select(F.col("hi").alias("node"), F.col("lo").alias("root")).join(known, "node", "left_anti")
            found = old.unionByName(fresh)
        roots = stored(found, "roots")
        rest = stored(moved.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
        forget(to, left, *([known] if known is not None else []))
        known, left = roots, rest
    if known is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    forget(left)
    return known
