"""Queries of column functions over values that the driver's tables give, with their SQL.

Values go by ids; the SQL computes what must come out from the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import payload
from cairn.functions import text as fn
from cairn.operators import metadata

from .model import table

#: Extensions by id, the kind of each, what checks it and what normalises it.
EXTENSIONS = ["jpg", "CR2", "zip", "docx", "pdf", "doc", "gif", "jfif", "7z", "txt", "mp4", "wav"]
KINDS = ["photo_jpeg", "photo_raw", "archive", "document", "document", "document", "image_gif", "photo_jpeg", "archive", "other", "video_mp4", "audio"]
VALIDATORS = ["media", "media", "zip", "zip", "pdf", "ole", "gif", "media", "7z", "none", "media", "media"]
ROUTES = ["photo", "photo", "archive", "document", "document", "document", "working", "photo", "archive", "none", "audio_video", "audio_video"]
TOOLS = [["builtin"], ["sevenzip", "exiftool"], ["exiftool", "ffprobe"], ["ffprobe"]]


def by_id(words: list[str]):
    return F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))


def listed(words: list[str], i: str = "doc_id") -> str:
    return f"[{', '.join(repr(w) for w in words)}][CAST({i} % {len(words)} + 1 AS INTEGER)]"


def path_keys(s: SparkSession, d: str) -> DataFrame:
    """Comparison keys of paths with letters in two forms."""
    path = F.concat("lang", F.lit("\\E\u0301t\u00c9/"), F.col("doc_id").cast("string"), F.lit("\u212b.TXT"))
    return table(s, d, "documents").select("doc_id", fn.path_key(path).alias("path_key"))


def entry_functions(s: SparkSession, d: str) -> DataFrame:
    """Attributes, kinds, validators and routes of files."""
    ext, attributes = by_id(EXTENSIONS), F.col("doc_id") * 1024
    kind, name = fn.media_kind(ext), F.when(F.col("doc_id") % 3 == 0, ext).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("."), ext)).otherwise(F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.lit("."), ext))
    enabled = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in TOOLS]), (F.col("doc_id") % 4 + 1).cast("int"))
    spec = fn.format_spec(fn.pick_validator(F.lower(ext), kind), kind, enabled)
    return table(s, d, "documents").select("doc_id", fn.is_placeholder(attributes).alias("placeholder"), fn.is_reparse(attributes).alias("reparse"), kind.alias("kind"), fn.pick_validator(F.lower(ext), kind).alias("validator"), metadata.route(kind).alias("route"), fn.is_raw_candidate(name).alias("raw"), spec["validator"].alias("spec"), spec["tool"].alias("tool"))


def time_functions(s: SparkSession, d: str) -> DataFrame:
    """Offsets, wall clocks and instants of written times."""
    i = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    date, clock = F.concat_ws(":", F.lit("2024"), two(i % 12 + 1), two(i % 28 + 1)), F.concat(two(i % 24), F.lit(":10:20.25"))
    offset = F.when(i % 5 == 0, "").otherwise(F.concat(F.when(i % 2 == 0, "+").otherwise("-"), two(i % 14), F.lit(":"), two(i % 4 * 15)))
    raw = F.concat_ws(" ", date, clock)
    value = F.concat(raw, offset)
    iso = F.concat(F.translate(date, ":", "-"), F.lit("T"), clock, F.when(offset == "", "Z").otherwise(offset))
    return table(s, d, "documents").select(
        "doc_id", fn.offset_minutes(offset).alias("minutes"), fn.offset_from_value(value).alias("ends_with"), fn.wall_clock(value).alias("wall"), fn.matching_offset(raw, F.array(F.lit("1999:01:01 00:00:00+09:00"), value)).alias("lent"),
        fn.capture_utc(raw, fn.offset_minutes(offset)).alias("utc"), fn.normalize_explicit_utc(iso).alias("iso_utc"),
    )


def number_functions(s: SparkSession, d: str) -> DataFrame:
    """Numbers and places in texts, ids of zeros."""
    i, n = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    pair = fn.first_positive_int_pair(F.concat(n.cast("string"), F.lit(" x "), (i % 7 - 3).cast("string"), F.lit(".5 mm")))
    degrees = F.concat((i % 90).cast("string"), F.lit(" deg "), (i % 60).cast("string"), F.lit("' "), (i % 30).cast("string"), F.lit('.5" '), by_id(["N", "S", "E", "W"]))
    return table(s, d, "documents").select(
        "doc_id", F.array_join(pair.cast("array<string>"), "x").alias("pair"), fn.gps_decimal(F.when(i % 5 == 0, i.cast("string")).otherwise(degrees)).alias("degrees"), fn.is_all_zero_id(F.when(i % 3 == 0, " 000 ").otherwise(i.cast("string"))).alias("zeros"),
        fn.throughput(n, i % 4).alias("rate"), fn.first_int(F.concat(F.lit("about "), i.cast("string"), F.lit(".75 s"))).alias("whole"),
    )


def disk_functions(s: SparkSession, d: str) -> DataFrame:
    """Names, numbers and states of disks."""
    k = F.col("p_partkey")
    text = k.cast("string")
    device = F.when(k % 4 == 0, F.concat(F.lit("\\\\.\\PhysicalDrive"), text)).when(k % 4 == 1, F.concat(F.lit("/dev/pd"), text)).when(k % 4 == 2, F.concat(F.lit("/dev/sd"), F.chr(97 + k % 26), F.chr(97 + k % 7))).otherwise("other")
    labels = F.when(k % 3 == 0, F.array(F.lit(" Data:1 "), F.lit("con"), F.lit(" Data:1 "))).otherwise(F.array().cast("array<string>"))
    letters = F.when(k % 2 == 0, F.array(F.lit("C:"), F.lit("D"))).otherwise(F.array().cast("array<string>"))
    name = F.concat(F.lit("/x/snap_"), F.lpad(F.hex(k), 8, "0"), F.when(k % 5 == 0, ".db").otherwise(".sqlite"))
    return table(s, d, "part").select(
        k.alias("part"), fn.disk_number(device).alias("number"), F.array_join(fn.smart_exit_flags((k % 256).cast("int")), "; ").alias("flags"), fn.collection_status((k % 256).cast("int"), k % 3 == 0).alias("status"), fn.clean(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("brand"),
        fn.int_or_none(F.when(k % 2 == 0, F.concat(F.lit(" "), text)).otherwise("x")).alias("number_or_none"), F.array_join(fn.unique_nonempty(F.array(F.lit(" a "), F.lit(""), F.col("p_brand"), F.lit("a"), F.col("p_brand"))), "|").alias("names"), fn.safe_component(F.concat(F.lit(" ._"), "p_name", F.lit("<>/  x. "))).alias("component"),
        fn.disk_identity(labels, letters, k).alias("identity"), fn.fingerprint_of_name(name).alias("fingerprint"), fn.drone_model(F.concat(F.lit("a: 1; Model_Name : M"), text, F.lit(" ; b: 2"))).alias("drone"), fn.compat_mode((k % 3).cast("int"), (k % 2).cast("int")).alias("mode"), fn.valid_digest(F.when(k % 2 == 0, F.sha2(text, 256)).otherwise(text)).alias("digest"),
    )


def payload_functions(s: SparkSession, d: str) -> DataFrame:
    """Canonical forms, digests and types of payloads."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit('{"b": '), i, F.lit(', "SourceFile": "x", "a": {"File:Directory": "d", "k": "v'), (F.col("doc_id") % 5).cast("string"), F.lit('"}, "n": null, "l": [true, {"FileAccessDate": 1}]}'))
    at = lambda path: F.try_variant_get(F.parse_json(text), path, "variant")
    return table(s, d, "documents").select(
        "doc_id", payload.canonical_json(text).alias("canonical"), payload.legacy_canonical_json(text).alias("legacy"), payload.drop_volatile(text).alias("stable"), payload.payload_digest(text).alias("digest"),
        F.concat_ws(",", *[payload.value_type(at(f"$.{x}")) for x in ("a", "b", "n", "l")], payload.value_type(at("$.a.k")), payload.value_type(at("$.l[0]"))).alias("types"), payload.scalar_or_json(at("$.b")).alias("scalar"), payload.scalar_or_json(at("$.a")).alias("nested"), payload.as_json_text(i).alias("listed"),
    )


QUERIES = {"path_keys": path_keys, "entry_functions": entry_functions, "time_functions": time_functions, "number_functions": number_functions, "disk_functions": disk_functions, "payload_functions": payload_functions}

_tools = "[" + ", ".join(str(t) for t in TOOLS) + "][CAST(doc_id % 4 + 1 AS INTEGER)]"

ORACLE_SQL = {
    "path_keys": "SELECT doc_id, replace(lower(nfc_normalize(lang || chr(92) || 'E' || chr(769) || 't' || chr(201) || '/' || CAST(doc_id AS VARCHAR) || chr(8491) || '.TXT')), chr(92), '/') AS path_key FROM documents",
    "entry_functions": f"""WITH f AS (SELECT doc_id, doc_id * 1024 AS attrs, {listed(KINDS)} AS kind, {listed(VALIDATORS)} AS validator, {listed(ROUTES)} AS route, {listed(EXTENSIONS)} AS ext, {_tools} AS tools FROM documents),
        t AS (SELECT *, list_contains(tools, 'builtin') AS b, list_contains(tools, 'sevenzip') AS z, list_contains(tools, 'exiftool') AS e, list_contains(tools, 'ffprobe') AND kind IN ('image_gif', 'video_mp4', 'audio') AS p FROM f)
        SELECT doc_id, attrs & 4460544 <> 0 AS placeholder, attrs & 1024 <> 0 AS reparse, kind, validator, route, ext = 'CR2' AS raw,
          CASE WHEN validator IN ('zip', 'pdf') AND b THEN validator WHEN validator IN ('7z', 'ole') AND z THEN validator WHEN validator IN ('media', 'gif') AND e AND p THEN validator WHEN validator IN ('media', 'gif') AND e THEN 'exiftool' WHEN validator IN ('media', 'gif') AND p THEN 'ffprobe' ELSE 'none' END AS spec,
          CASE WHEN validator IN ('zip', 'pdf') AND b THEN 'builtin' WHEN validator IN ('7z', 'ole') AND z THEN '7-Zip' WHEN validator IN ('media', 'gif') AND e AND p THEN 'exiftool+ffprobe' WHEN validator IN ('media', 'gif') AND e THEN 'exiftool' WHEN validator IN ('media', 'gif') AND p THEN 'ffprobe' ELSE 'none' END AS tool FROM t""",
    "time_functions": """WITH b AS (SELECT doc_id, doc_id % 12 + 1 AS m, doc_id % 28 + 1 AS d, doc_id % 24 AS h, CASE WHEN doc_id % 5 <> 0 THEN (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END) * (doc_id % 14 * 60 + doc_id % 4 * 15) END AS o FROM documents)
        SELECT doc_id, CAST(o AS INTEGER) AS minutes, CAST(o AS INTEGER) AS ends_with, printf('2024:%02d:%02d %02d:10:20', m, d, h) AS wall, CAST(o AS INTEGER) AS lent, strftime(make_timestamp(2024, m, d, h, 10, 20.0) - to_minutes(CAST(o AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '.25Z' AS utc,
          strftime(make_timestamp(2024, m, d, h, 10, 20.0) - to_minutes(CAST(coalesce(o, 0) AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '.25Z' AS iso_utc FROM b""",
    "number_functions": """WITH b AS (SELECT doc_id AS i, coalesce(n_chars, 0) AS n FROM documents) SELECT i AS doc_id, CASE WHEN n > 0 AND i % 7 > 3 THEN n || 'x' || i % 7 - 3 END AS pair,
          CASE WHEN i % 5 <> 0 THEN (CASE WHEN i % 4 IN (1, 3) THEN -1 ELSE 1 END) * ((i % 90)::DOUBLE + (i % 60)::DOUBLE / 60 + ((i % 30) + 0.5::DOUBLE) / 3600) END AS degrees, i % 3 = 0 OR i = 0 AS zeros, CASE WHEN i % 4 > 0 AND n > 0 THEN n::DOUBLE / (i % 4) ELSE 0.0::DOUBLE END AS rate, i AS whole FROM b""",
    "disk_functions": """WITH b AS (SELECT p_partkey AS k, p_brand, p_name, ['command line or internal error', 'device can''t be opened or identified', 'SMART command failed', 'SMART overall health failed', 'prefail attribute at or below threshold', 'attribute was at or below threshold before', 'error log has entries', 'self-test log has errors'] AS words FROM part),
        c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(' ._' || p_name || '<>/  x. '), '[<>:"/\\\\|?*\\x00-\\x1f]+', '_', 'g'), '\\s+', ' ', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS part_name FROM b)
        SELECT k AS part, CAST(CASE k % 4 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN (k % 26 + 1) * 26 + k % 7 END AS INTEGER) AS number, array_to_string([words[j + 1] for j in range(8) if (k % 256 >> j) & 1 = 1], '; ') AS flags,
          CASE WHEN k % 256 & 7 <> 0 THEN 'incomplete' WHEN k % 256 <> 0 OR k % 3 = 0 THEN 'complete_with_warnings' ELSE 'complete' END AS status, trim(p_brand) AS brand, CASE WHEN k % 2 = 0 THEN k END AS number_or_none, CASE WHEN p_brand IN ('', 'a') THEN 'a' ELSE 'a|' || p_brand END AS names,
          regexp_replace(substr(part_name, 1, 80), '[ ._]+$', '') AS component, CASE WHEN k % 3 = 0 THEN 'Data_1+_con' WHEN k % 2 = 0 THEN 'C+D' ELSE 'PhysicalDrive' || k END AS identity, CASE WHEN k % 5 <> 0 THEN lpad(upper(to_hex(k)), 8, '0') END AS fingerprint, 'M' || k AS drone,
          CASE WHEN k % 3 = k % 2 THEN k % 3 || '/' || k % 2 ELSE 'cross' END AS mode, CASE WHEN k % 2 = 0 THEN sha256(CAST(k AS VARCHAR)) END AS digest FROM c""",
    "payload_functions": """WITH b AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, CAST(doc_id % 5 AS VARCHAR) AS v FROM documents),
        c AS (SELECT *, '{"SourceFile":"x","a":{"File:Directory":"d","k":"v' || v || '"},"b":' || i || ',"l":[true,{"FileAccessDate":1}],"n":null}' AS canonical, '{"a":{"k":"v' || v || '"},"b":' || i || ',"l":[true,{}],"n":null}' AS stable FROM b)
        SELECT doc_id, canonical, canonical AS legacy, stable, sha256(stable) AS digest, 'json,integer,null,json,text,boolean' AS types, i AS scalar, '{"File:Directory":"d","k":"v' || v || '"}' AS nested, '["' || i || '"]' AS listed FROM c""",
}
