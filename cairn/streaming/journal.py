"""Journals as streams. Each has a batch twin that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.sources.journals import parsed_lines


def journal_stream(spark: SparkSession, path: str, good: str, bad: str, checkpoint: str) -> StreamingQuery:
    """Append the lines of new journal files to one of two folders; lines that are no event are kept apart."""

    def split(batch: DataFrame, number: int) -> None:
        # A batch that is done again after a failure overwrites its own folder: rows are there once.
        rows = parsed_lines(batch)
        for keep, folder, columns in (("good", good, ["value", "event"]), ("not good", bad, ["value"])):
            rows.where(keep).select(*columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return spark.readStream.text(path).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_attempts(attempts: DataFrame) -> DataFrame:
    """entry, stage and status of the latest attempt: batch or stream (update or complete mode)."""
    return attempts.groupBy("entry", "stage").agg(F.max_by("status", "attempt_number").alias("status"), F.max("attempt_number").alias("attempt_number"))


def event_rollup(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of value by event type in windows of time; as a stream, windows close ``delay`` after their end."""
    late = events.withWatermark("ts", delay) if events.isStreaming else events
    return late.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("day"), "event_type", "n", "value")


def distinct_events(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """Events whose keys weren't there before, within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


#: An attempt and what became of it.
FATE = "entry bigint, stage string, attempt_number bigint, fate string, started timestamp"
#: What names an attempt in a state; ``nulls`` has a bit for each of the others that is null.
NAMED = ["nulls", "entry", "stage", "attempt_number"]
#: No such time, in microseconds.
NEVER = np.iinfo("int64").max


def _packed(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held.astype({"stage": "category", "status": "category"}), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as found:
        return found.read_pandas().astype({"stage": "object", "status": "object"})


def _merged(held: pd.DataFrame | None, batch: pd.DataFrame) -> pd.DataFrame:
    """Attempts with the first start and the first end of each; ``until`` is 0 for those that aren't told."""
    batch = batch[batch.status.notna() & batch["at"].notna()]
    begins = batch.status == "running"
    at = batch["at"].astype("int64")
    more = batch[NAMED].assign(started=at.where(begins, NEVER), ended=at.where(~begins, NEVER), status=batch.status.where(~begins, ""), until=0)
    every = more if held is None else pd.concat([held, more])
    groups = every.sort_values(["ended", "status"]).groupby(NAMED, sort=False)
    return groups.agg(started=("started", "min"), ended=("ended", "first"), status=("status", "first"), until=("until", "max")).reset_index()


def attempt_fates(attempts: DataFrame, after: str = "1 hour", delay: str = "10 minutes", keep: str = "7 days", buckets: int = 1024) -> DataFrame:
    """What became of every attempt (FATE): the status that it ended with, or abandoned where no end came within ``after`` of its start.

    attempts: entry, stage, attempt_number, status and ts; ``running`` is a start,
    all else an end. The first of several starts counts, and of several ends. An
    attempt is told when the watermark (the latest ts less ``delay``) has passed
    its end or the time for it, so that rows in any order give one answer. As a
    stream (append mode) start and end are kept in state, and a timer of event
    time tells the attempt. An end that comes after its attempt was told abandoned is ignored, for ``keep``.

    Attempts that are open or kept share one of ``buckets`` states by the hash of
    their names, with one timer for the first that is due; so Python is called once a bucket
    and batch, not once an attempt. A checkpoint goes with its number of buckets.
    """
    if not attempts.isStreaming:
        ends = F.col("status") != "running"
        per = attempts.groupBy("entry", "stage", "attempt_number").agg(F.min(F.when(~ends, F.col("ts"))).alias("started"), F.min(F.when(ends, F.struct("ts", "status"))).alias("end"), F.max("ts").alias("last"))
        mark = per.agg((F.max("last") - F.expr(f"interval {delay}")).alias("mark"))  # one row
        limit = F.col("started") + F.expr(f"interval {after}")
        due = F.least("end.ts", limit)  # of what is known
        fate = F.when(F.col("started").isNull() | (F.col("end.ts") <= limit), F.col("end.status")).otherwise("abandoned")
        return per.join(F.broadcast(mark), due < F.col("mark")).select("entry", "stage", "attempt_number", fate.alias("fate"), "started")
    span, kept = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (after, keep))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _unpacked(state.get[0]) if state.exists else None
        for batch in () if state.hasTimedOut else batches:
            held = _merged(held, batch)
        mark_ms = state.getCurrentWatermarkMs()
        mark = mark_ms * 1000
        limit = held.started.where(held.started == NEVER, held.started + span)
        due = np.minimum(held.ended, limit)
        tell = (held.until == 0) & (due < mark)
        if tell.any():
            fate = held.status.where((held.ended < NEVER) & (held.ended <= limit), "abandoned")
            yield held[tell][[*NAMED, "started"]].assign(fate=fate[tell])
            held["until"] = held.until.where(~tell, np.maximum(due + kept, mark + 1000))
        left = (held.until == 0) | (held.until >= mark)
        if left.any():
            state.update((_packed(held[left]),))
            next_due = int(due.where(held.until == 0, held.until)[left].min())
            state.setTimeoutTimestamp(max(next_due // 1000, mark_ms + 1))
        elif state.exists:
            state.remove()

    names = NAMED[1:]
    nulls = sum((F.col(c).isNull().cast("int") * 2**k for k, c in enumerate(names)), F.lit(0))
    filled = [F.coalesce(F.col(c).cast(kind), F.lit(none).cast(kind)).alias(c) for c, kind, none in zip(names, ("bigint", "string", "bigint"), (0, "", 0), strict=True)]
    rows = attempts.withWatermark("ts", delay).select(F.pmod(F.xxhash64(*names), F.lit(buckets)).alias("bucket"), nulls.alias("nulls"), *filled, "status", F.unix_micros("ts").alias("at"), "ts")
    told = rows.groupBy("bucket").applyInPandasWithState(follow, "nulls int, entry bigint, stage string, attempt_number bigint, started bigint, fate string", "attempts binary", "append", GroupStateTimeout.EventTimeTimeout)
    whole = [F.when(F.col("nulls").bitwiseAND(2**k) == 0, F.col(c)).alias(c) for k, c in enumerate(names)]
    return told.select(*whole, "fate", F.timestamp_micros(F.nullif("started", F.lit(NEVER))).alias("started"))
