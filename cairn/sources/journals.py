"""Event journals and recorded JSON profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.ranking import latest_by

from .storage import stored

STATUSES = ["valid", "invalid", "unsupported", "timeout", "error", "unstable"]


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds event (its name) and good: JSON with an event."""
    event = F.try_variant_get(F.try_parse_json(value), "$.event", "string")
    return lines.withColumn("event", event).withColumn("good", event.isNotNull())


def _last_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch.file:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                size = at = f.size()
                tail = b""
                while at > 0 and b"\n" not in tail:
                    step = min(at, 1 << 16)
                    at -= step
                    f.seek(at)
                    tail = f.read(step) + tail
            line = tail.rpartition(b"\n")[2]
            rows.append((path, hashlib.sha256(line.rstrip(b"\r")).hexdigest() if size and line else None))
        yield pd.DataFrame(rows, columns=["file", "unterminated"])


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """value and event of every line of JSON-lines files. A bad line is an error, unless it is a file's last and unterminated.

    Files with one bad line are looked at from their ends, as far back as their last line goes.
    """
    lines = parsed_lines(spark.read.text(path).where("trim(value) <> ''").select("value", F.col("_metadata.file_path").alias("file")))
    bad = stored(lines.where("not good").groupBy("file").agg(F.count("*").alias("n"), F.sha2(F.max("value").cast("binary"), 256).alias("sha")), "bad-lines")
    ends = bad.where("n = 1").select("file").mapInPandas(_last_lines, "file string, unterminated string")
    if not bad.join(ends, "file", "left").where("n > 1 or unterminated is null or unterminated <> sha").isEmpty():
        raise ValueError(f"{path}: a line is no event")
    return lines.where("good").select("value", "event")


def decode_records(journal: DataFrame) -> DataFrame:
    """The latest record of each entry in a decoding journal (entry, sequence, status, width, height, path); rows that contradict themselves are left out."""
    sound = F.col("status").isin(STATUSES) & ((F.col("status") != "valid") | ((F.col("width") > 0) & (F.col("height") > 0))) & (~F.col("status").isin("valid", "unsupported") | F.col("path").isNull())
    return latest_by(journal.where(sound), ["entry"], "sequence")


PROFILE = "disk struct<number:bigint,friendly_name:string,serial_number:string,unique_id:string,size:bigint,bus_type:string>, partitions array<struct<partition_number:bigint,offset:bigint,size:bigint,volume:struct<drive_letter:string,file_system_label:string,size:bigint,size_remaining:bigint>>>"


def read_disk_profiles(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """disks, partitions and volumes from JSON profiles; profiles without a disk number are left out."""
    found = spark.read.schema(PROFILE).option("multiLine", "true").json(path).where("disk.number is not null")
    disks = found.select(F.col("disk.number").alias("disk"), "disk.size", "disk.unique_id", F.col("disk.serial_number").alias("serial"))
    parts = found.select(F.col("disk.number").alias("disk"), F.explode("partitions").alias("p"))
    partitions = parts.select("disk", "p.offset", "p.size", F.col("p.volume.drive_letter").alias("drive_letter"), F.col("p.volume.file_system_label").alias("label"))
    volumes = parts.where("p.volume is not null").select("disk", "p.volume.*")
    return {"disks": disks, "partitions": partitions, "volumes": volumes}


def flat_rows(df: DataFrame, text: str, keys: list[str], levels: int | None = None) -> DataFrame:
    """``keys``, key and value of every scalar and list in JSON objects (column ``text``), at any depth; keys are joined by dots.

    Objects are taken apart level by level, only those that are left at a level; the
    number of jobs is that of the deepest object's levels. Empty objects give nothing, as do
    texts that are no JSON object; texts that look like objects stay texts. ``levels`` stops there: deeper objects stay JSON.
    """
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    top = F.try_parse_json(text)
    level, prefix, out = df.select(*keys, F.lit(None).cast("string").alias("_path"), top.alias("_v")).where(is_object(F.col("_v"))), F.col("_path"), []
    depth = 0
    while True:
        depth += 1
        inner = level.select(*keys, "_path", F.explode(F.col("_v").cast("map<string,variant>")).alias("_k", "_v"))
        found = stored(inner.select(*keys, F.concat_ws(".", prefix, "_k").alias("_path"), F.to_json("_v").alias("_json"), F.try_variant_get("_v", "$", "string").alias("_text"), F.coalesce(is_object(F.col("_v")), F.lit(False)).alias("_more")), "level")
        last = levels is not None and depth >= levels
        done = found if last else found.where("not _more")
        out.append(done.select(*keys, F.col("_path").alias("key"), F.when(F.col("_more"), F.col("_json")).otherwise(F.coalesce("_text", F.nullif(F.col("_json"), F.lit("null")))).alias("value")))
        if last or found.where("_more").isEmpty():
            break
        level = found.where("_more").select(*keys, "_path", F.parse_json("_json").alias("_v"))
    rows = out[0]
    for part in out[1:]:
        rows = rows.unionByName(part)
    return rows


def flat_counts(text: Column, depth: int = 8) -> Column:
    """Nested JSON counts as an array of struct(key, value), keys joined by dots, down to ``depth`` levels; what is deeper stays JSON."""
    level = F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    for _ in range(depth - 1):
        level = F.flatten(F.transform(level, _unfold))
    return level


def _unfold(e: Column) -> Column:
    inner = F.when(e["value"].startswith("{"), F.from_json(e["value"], "map<string,string>"))
    below = F.transform(F.map_entries(inner), lambda x: F.struct(F.concat_ws(".", e["key"], x["key"]).alias("key"), x["value"].alias("value")))
    return F.coalesce(below, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))
