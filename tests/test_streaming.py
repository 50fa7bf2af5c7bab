"""Streams that are stopped between micro-batches or fail in one give what their batch twins give."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cairn.streaming import journal

ATTEMPTS = "entry long, stage string, attempt_number long, status string, ts timestamp"
START = datetime(2024, 1, 1)


def attempt_rows():
    """Attempts in six parts of an hour and a half: starts, ends in time, too late or never, repeated rows, and rows that come a part later within the delay."""
    rng = random.Random(5)
    parts = [[] for _ in range(6)]
    for k in range(300):
        at = timedelta(minutes=rng.randrange(9 * 60))
        rows = [(k % 40, "hash", k, "running", at)]
        if rng.random() < 0.7:
            rows.append((k % 40, "hash", k, rng.choice(["succeeded", "failed"]), at + timedelta(minutes=rng.choice([1, 30, 60, 61, 90]))))
        for r in rows:
            part = min(5, int(r[4].total_seconds() // 5400))
            if rng.random() < 0.2 and part < 5 and r[4] > timedelta(minutes=90 * (part + 1) - 100):
                part += 1
            parts[part] += [r] * rng.choice([1, 1, 2])
    return [[(*r[:4], START + r[4]) for r in p] for p in parts]


@pytest.mark.parametrize("name", ["fates", "latest", "rollup", "distinct"])
def test_restarts(spark, tmp_path, name):
    """A run for each part, each a restart from the checkpoint; the one of the third part fails after its state was written and is done again."""
    delay = "100 minutes"
    make = {
        "fates": lambda df: journal.attempt_fates(df, "1 hour", delay),
        "latest": lambda df: journal.latest_attempts(df.where("status <> 'running'")),  # an attempt has one status
        "rollup": lambda df: journal.event_rollup(df.withColumn("event_type", F.col("status")).withColumn("value", F.col("attempt_number").cast("double")), delay, "1 hour"),
        "distinct": lambda df: journal.distinct_events(df, ["entry", "attempt_number", "status", "ts"], delay),
    }[name]
    mode = {"latest": "update", "rollup": "update"}.get(name, "append")
    parts, source, out = attempt_rows(), str(tmp_path / "in"), str(tmp_path / "out")
    keep = {"latest": ["entry", "stage"], "rollup": ["day", "event_type"]}.get(name)
    broken = {2}

    def sink(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/b={number}")
        if len(list((tmp_path / "in").glob("*.parquet"))) == 3 and broken:
            broken.clear()
            raise RuntimeError("the driver is lost")

    for k, part in enumerate(parts):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.mode("append").parquet(source)
        run = lambda: make(spark.readStream.schema(ATTEMPTS).parquet(source)).writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        if k == 2:
            with pytest.raises(Exception, match="lost"):
                run()
        run()
    found = spark.read.parquet(out)
    if keep:  # of an updated row the last counts
        found = found.groupBy(*keep).agg(F.max_by(F.struct(*[c for c in found.columns if c not in (*keep, "batch", "b")]), "batch").alias("x")).select(*keep, "x.*")
    want = make(spark.read.schema(ATTEMPTS).parquet(source))
    columns = sorted(want.columns)
    rows = lambda df: sorted(map(str, df.select(columns).collect()))
    got, due = rows(found), rows(want)
    assert (sorted(set(got) - set(due)), sorted(set(due) - set(got))) == ([], [])
    assert got == due and len(due) > 20
    if name == "fates":
        assert {r.fate for r in want.collect()} == {"succeeded", "failed", "abandoned"}


def test_fates_share_states(spark, tmp_path):
    """States and timers are as many as buckets, whatever the number of attempts; names may be null, and an end without a status is none."""
    rows = [(None if k % 50 == 0 else k % 40 + 2**60, None if k % 70 == 0 else "hash", None if k % 90 == 0 else k, "running", START + timedelta(seconds=k * 7, microseconds=k)) for k in range(3000)]
    rows += [(*r[:3], None if k % 11 == 0 else "succeeded", r[4] + timedelta(minutes=k % 90)) for k, r in enumerate(rows) if k % 3]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.mode("append").parquet(source)
        told = journal.attempt_fates(spark.readStream.schema(ATTEMPTS).parquet(source), "1 hour", "1 day", buckets=8)
        query = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes += [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    spark.createDataFrame([(1, "last", 1, "running", START + timedelta(days=2))], ATTEMPTS).write.mode("append").parquet(source)
    journal.attempt_fates(spark.readStream.schema(ATTEMPTS).parquet(source), "1 hour", "1 day", buckets=8).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    show = lambda df: sorted(map(str, df.collect()))
    found, want = show(spark.read.schema(journal.FATE).parquet(out)), show(journal.attempt_fates(spark.read.schema(ATTEMPTS).parquet(source), "1 hour", "1 day"))
    assert found == want and len(want) > 2900
    assert max(sizes) == 8
