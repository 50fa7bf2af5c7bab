"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. Shards are runs of page_id and digest, cut
where the running sum of payload bytes passes a shard's share, so they depend on
the pages alone, not on how Spark split its input or how ids are spread. Each
shard is written by one task, a gzip member a record, into files that roll at a
compressed size. Tasks write under temporary names and leave a manifest; once all
have ended, a second job renames what the manifest lists, and the manifest beside
the files marks the archive as whole. The folder must be on storage that the
driver and all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, forget, fresh_dir, in_arrow, salted_join, slices, stored

#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: A file ends with the record that takes it to this compressed size. The reader takes a file as one value.
ROLL_BYTES = 32 << 20
#: Payload bytes of a shard, once there are 64 shards; with less data shards are smaller, down to 1 MB.
SHARD_BYTES = 256 << 20
#: Rows of pages in a range whose bytes one task adds up.
RANGE_ROWS = 1_000_000
#: Fixed values of the format.
VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("temporary", T.StringType()), ("shard", T.LongType()), ("records", T.LongType()), ("bytes", T.LongType()), ("sha256", T.StringType()))])
RECORDS = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("digests_hold", T.BooleanType()), ("record_id", T.StringType()))])


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    """The same for the same page, whenever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {copy}')}>"


def sha1_label(data: bytes | None = None, digest: str | None = None) -> str:
    raw = bytes.fromhex(digest) if digest else hashlib.sha1(data or b"").digest()
    return "sha1:" + base64.b32encode(raw).decode()


def one_line(text: str | None) -> str:
    """A header's value: what would end the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in text or "")


def record(page_id: int | None, url: str | None, html: str | None, digest: str, copy: int, refers_to: tuple[int | None, int] | None) -> bytes:
    """A record with headers and digests made anew. refers_to: page and copy of the response that a revisit has the payload of."""
    payload = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", sha1_label(digest=digest)), ("WARC-Block-Digest", sha1_label(block)),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is None:
        fields.append(("X-No-Url", "1"))
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], digest, refers_to[1]))]
        if refers_to[0] is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers_to[0])))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join([VERSION + "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"])
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Roller:
    """Writes the files of a shard, one at a time, under temporary names."""

    def __init__(self, uri: str, shard: int, roll_bytes: int, run_id: str):
        self.fs, self.top = file_system(uri)
        self.run_id = run_id
        self.shard, self.roll_bytes, self.number, self.out, self.rows = shard, roll_bytes, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f".{self.name}.{self.run_id}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(f"{self.top}/{self.temporary}", compression=None)
            self.records, self.size, self.sum = 0, 0, hashlib.sha256()
        packed = member(data)
        self.out.write(packed)
        self.records, self.size = self.records + 1, self.size + len(packed)
        self.sum.update(packed)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.rows.append((self.name, self.temporary, self.shard, self.records, self.size, self.sum.hexdigest()))
            self.out, self.number = None, self.number + 1


def shards_of(pages: DataFrame) -> tuple[DataFrame, int]:
    """One row: where shards after the first begin, in two levels; and the number of shards.

    Ranges are Spark's and differ from run to run; running sums over them don't.
    The driver sees a number a range and the first key of every shard, which is some
    60 bytes for SHARD_BYTES of payload.
    """
    spark = pages.sparkSession
    weights = stored(pages.groupBy("page_id", "digest").agg(F.sum(F.col("bytes") + 1).alias("w")), "weights")
    rows, total = weights.agg(F.count("*"), F.sum("w")).first()
    n = max(1, -(-(total or 0) // SHARD_BYTES), min(64, (total or 0) >> 20))
    ranged = stored(weights.repartitionByRange(max(8, -(-rows // RANGE_ROWS)), "page_id", "digest").withColumn("part", F.spark_partition_id()), "ranges")
    before, held = [], 0
    for r in ranged.groupBy("part").agg(F.sum("w").alias("w")).orderBy("part").collect():
        before.append((r.part, held))
        held += r.w
    before = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    order = Window.partitionBy("part").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(before, "part").select("page_id", "digest", (F.col("before") + F.coalesce(F.sum("w").over(order), F.lit(0))).alias("held"))
    share = -(-max(total or 0, 1) // n)
    firsts = placed.groupBy(F.expr(f"held div {share}L").alias("shard")).agg(F.min(F.struct("page_id", "digest")).alias("first")).orderBy("shard").select("first.*").collect()
    firsts = [(r.page_id, r.digest) for r in firsts][1:]
    step = max(1, int(len(firsts) ** 0.5))
    levels = [firsts[k : k + step] for k in range(0, len(firsts), step)]
    key = "struct<page_id: long, digest: string>"
    return spark.createDataFrame([([x[0] for x in levels], levels)], f"_heads array<{key}>, _levels array<array<{key}>>"), len(firsts) + 1


def with_shard(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Add the shard of each row: how many shards after the first begin at its key or before."""
    key = F.struct("page_id", "digest")
    level = F.size(F.filter("_heads", lambda b: b <= key))
    inside = F.size(F.filter(F.get("_levels", F.greatest(level - 1, F.lit(0))), lambda b: b <= key))
    joined = rows.join(F.broadcast(starts))  # one row
    # All levels but the last are as long as the first one.
    shard = F.when(level > 0, (level - 1) * F.size(F.get("_levels", F.lit(0))) + inside).otherwise(0)
    return joined.withColumn("shard", shard.cast("int")).drop("_heads", "_levels")


def write_warc(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record for every row; returns the manifest, a row a file.

    Of rows with equal payloads of at least REVISIT_BYTES, the one with the
    largest page_id is the response and others revisit it; where several have
    that page_id (repeated rows), the first by url is. A null payload is empty, a
    null page_id sorts first and is left out of the record, a null url is
    written empty and read back as null. Ids may be any long. Other columns are ignored; an empty
    table gives an archive without files.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    shaped = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    ids = shaped.select("page_id", "digest", "bytes").where(F.col("bytes") >= REVISIT_BYTES)
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = salted_join(ids, last, "digest", ["page_id"], "inner", 32).where(F.coalesce(F.col("page_id") < F.col("refers_to"), F.col("refers_to").isNotNull()))
    starts, n = shards_of(shaped.select("page_id", "digest", "bytes"))
    # What a page revisits travels to the page's own range and comes just before it there: payloads move once.
    hints = revisits.select("page_id", "digest", "bytes", "refers_to", F.lit(0).alias("kind"))
    both = with_shard(shaped.withColumn("kind", F.lit(1)).unionByName(hints, allowMissingColumns=True), starts)
    columns = ["page_id", "shard", "digest", "bytes", "url", "html", "refers_to", "kind"]
    both = both.select(*columns).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    store, top = file_system(uri)
    store.create_dir(top, recursive=True)
    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Roller | None = None
        same: tuple | None = None
        copy, refers = 0, None
        for big in batches:
            for part in slices(big):
                for page_id, shard, digest, size, url, html, refers_to, kind in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if out is None or out.shard != shard:
                        if out:
                            out.close()
                            yield rows_of(out.rows)
                        out = Roller(uri, shard, roll_bytes, run_id)
                    if (page_id, digest) != same:
                        same, copy, refers = (page_id, digest), 0, None
                    if kind == 0:
                        refers = (refers_to, 0)
                        continue
                    if refers is None and copy and size >= REVISIT_BYTES:
                        refers = (page_id, 0)
                    out.add(record(page_id, url, html, digest, copy, refers))
                    copy += 1
        if out:
            out.close()
            yield rows_of(out.rows)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=MANIFEST.names)

    pending = f"{uri}/_pending-{run_id}"
    in_arrow(both, run, MANIFEST).write.parquet(pending)
    commit(spark, uri, pending)
    # What failed attempts of this run have left, and the list of what is renamed by now.
    for info in store.get_file_info(fs.FileSelector(top)):
        if info.base_name.endswith(".tmp") and f".{run_id}." in info.base_name:
            store.delete_file(info.path)
    store.delete_dir(f"{top}/_pending-{run_id}")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/_manifest")


def commit(spark: SparkSession, uri: str, pending: str) -> None:
    """Rename what the pending manifest lists, then write the manifest. A second attempt finds what the first has renamed."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = file_system(uri)
        for batch in batches:
            for name, temporary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if store.get_file_info(f"{top}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{top}/{temporary}", f"{top}/{name}")
                elif store.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{uri}/{name}")
            yield batch

    listed = spark.read.schema(MANIFEST).parquet(pending)
    in_arrow(listed, rename, MANIFEST).write.parquet(f"{uri}/_manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    view = memoryview(data)
    while len(view):
        unpacker = zlib.decompressobj(31)
        out = unpacker.decompress(view)
        yield out
        view = view[len(view) - len(unpacker.unused_data) :] if unpacker.unused_data else view[:0]


def parsed(data: bytes) -> tuple:
    """A record as a row of RECORDS."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(http.rpartition(b"Content-Length: ")[2])
    kind = fields["WARC-Type"]
    holds = sha1_label(block) == fields["WARC-Block-Digest"]
    if kind == "response":
        size, found = len(payload), hashlib.sha1(payload).hexdigest()
        holds, digest = holds and found == digest, found
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), None if "X-No-Url" in fields else fields["WARC-Target-URI"], kind, number("X-Refers-To-Page-Id"), size, digest, holds, fields["WARC-Record-ID"]


def read_warc(spark: SparkSession, uri: str) -> DataFrame:
    """The records of an archive, read from its files: RECORDS, with digests of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        for big in batches:
            for at in range(big.num_rows):
                rows = []
                for x in members(big.column(0)[at].as_py()):
                    rows.append(parsed(x))
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=RECORDS.names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=RECORDS.names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(uri)
    return in_arrow(found.select("content"), run, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archive back."""
    uri = fresh_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS response FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN response <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response <> p.page_id THEN response END AS refers_to
FROM p LEFT JOIN last ON p.payload_bytes >= 1000 AND p.payload_digest = last.payload_digest
"""
