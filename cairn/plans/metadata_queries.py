"""Queries of the metadata normalisers over payloads that ``documents`` and ``pages`` stand for, with their SQL.

A document's payload is the JSON that a tag tool would give for a photo, a
page's that of a stream tool for a film; values go by ids and lengths. The SQL
computes what must come out from the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.payload import tag_map, tags
from cairn.operators import metadata
from cairn.sources import files

from .model import table
from .projections import union_shaped


def photo_payloads(s: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    text = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    pairs = {
        "IFD0:Make": F.when(i % 2 == 0, "Canon").otherwise("Nikon"), "Canon:Main:CanonModelID": text("R", (i % 7).cast("string")), "ExifIFD:DateTimeOriginal": text("2024:03:", two(i % 28 + 1), " ", two(i % 24), ":10:20.5"),
        "ExifIFD:OffsetTimeOriginal": F.when(i % 3 == 0, "+08:00").otherwise(""), "ExifIFD:FNumber": ((i % 9) / 2).cast("string"), "ExifIFD:FocalLength": text((i % 50).cast("string"), " mm"), "ExifIFD:Copy1:ISO": F.lit("99"), "ExifIFD:Main:ISO": (i % 6400).cast("string"),
        "File:ImageWidth": F.coalesce("n_chars", F.lit(0)).cast("string"), "Composite:GPSLatitude": text((i % 90).cast("string"), " deg 30' 0.00\" S"), "ExifIFD:LensSerialNumber": F.when(i % 5 == 0, "0000").otherwise(i.cast("string")), "ExifTool:Warning": F.when(i % 4 == 0, "[minor] odd").otherwise("truncated"),
    }
    doc = F.to_json(F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*pairs.values())))
    return table(s, d, "documents").select(i.alias("entry"), doc.alias("payload"), F.lit("cr3").alias("extension"))


def tagged(s: SparkSession, d: str) -> DataFrame:
    return tag_map(tags(photo_payloads(s, d), ["entry", "extension"]), ["entry", "extension"])


def film_payloads(s: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    place = F.concat(F.lit("+"), (i % 80).cast("string"), F.lit(".5+"), (i % 170).cast("string"), F.lit(".25/"))
    video = F.to_json(F.struct(F.lit(0).alias("index"), F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.octet_length("html").alias("width"), F.struct(place.alias("location")).alias("tags")))
    audio = F.to_json(F.struct(F.lit(1).alias("index"), F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), (i % 3 * 24000).cast("string").alias("sample_rate"), F.concat((i % 100).cast("string"), F.lit(".5")).alias("duration")))
    return table(s, d, "pages").select(i.alias("entry"), F.concat(F.lit('{"streams":['), video, F.when(i % 2 == 0, F.concat(F.lit(","), audio)).otherwise(""), F.lit("]}")).alias("payload"))


def photos(s: SparkSession, d: str) -> DataFrame:
    return metadata.photo(tagged(s, d)).select("entry", "capture_time_raw", "capture_tz_offset_min", "capture_time_utc", "camera_make", "camera_model", "lens_serial", "width", "iso", "f_number", "focal_length_mm", "gps_latitude")


def media_streams(s: SparkSession, d: str) -> DataFrame:
    films = film_payloads(s, d)
    return union_shaped({"video": metadata.streams(films, "video").select("entry", "stream_index", "codec_name", "width"), "audio": metadata.streams(films, "audio").select("entry", "stream_index", "codec_name", "sample_rate", "duration_seconds")})


def listings(s: SparkSession, d: str) -> DataFrame:
    """Pages as members of archives: the archive goes by the id's last digits, and is listed in runs of a thousand pages at most."""
    one = F.concat(F.lit("Path = "), F.col("url"), F.lit("\nSize = "), F.octet_length("html").cast("string"), F.lit("\nPacked Size = "), (F.col("page_id") % 1000).cast("string"), F.lit("\nEncrypted = "), F.when(F.col("page_id") % 9 == 0, "+").otherwise("-"), F.lit("\n\n"))
    run = F.expr("page_id div 1000000")
    return table(s, d, "pages").groupBy((F.col("page_id") % 1000).cast("string").alias("path"), run.alias("run")).agg(F.concat(F.lit("head\n----------\n"), F.array_join(F.array_sort(F.collect_list(one)), "")).alias("text")).drop("run")


QUERIES = {
    "photo_metadata": photos,
    "photo_validation": lambda s, d: metadata.validation(tagged(s, d)).groupBy("diagnostic_code").agg(F.count("*").alias("n")),
    "reported_diagnostics": lambda s, d: metadata.reported(photo_payloads(s, d)).groupBy("severity", "field_name", "message").agg(F.count("*").alias("n")),
    "media_streams": media_streams,
    "gps_points": lambda s, d: metadata.gps_points(film_payloads(s, d)),
    "archive_listing": lambda s, d: files.archive_totals(files.listing_members(listings(s, d))),
    "payload_digests": lambda s, d: metadata.build_payload(film_payloads(s, d).withColumn("provider", F.lit("streams"))).select("entry", "provider", "payload_sha256", "uncompressed_bytes"),
}

ORACLE_SQL = {
    "photo_metadata": """SELECT doc_id AS entry, '2024:03:' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || ' ' || lpad(CAST(doc_id % 24 AS VARCHAR), 2, '0') || ':10:20.5' AS capture_time_raw, CASE WHEN doc_id % 3 = 0 THEN 480 END AS capture_tz_offset_min,
        CASE WHEN doc_id % 3 = 0 THEN strftime(make_timestamp(2024, 3, doc_id % 28 + 1, doc_id % 24, 10, 20) - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '.5Z' END AS capture_time_utc, CASE WHEN doc_id % 2 = 0 THEN 'Canon' ELSE 'Nikon' END AS camera_make,
        'R' || CAST(doc_id % 7 AS VARCHAR) AS camera_model, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id AS VARCHAR) END AS lens_serial, coalesce(n_chars, 0) AS width, doc_id % 6400 AS iso, CASE WHEN doc_id % 9 > 0 THEN (doc_id % 9) / 2.0::DOUBLE END AS f_number,
        CASE WHEN doc_id % 50 > 0 THEN (doc_id % 50)::DOUBLE END AS focal_length_mm, -((doc_id % 90)::DOUBLE + 30.0 / 60) AS gps_latitude FROM documents""",
    "photo_validation": """SELECT 'invalid_all_zero_lens_serial' AS diagnostic_code, count(*) AS n FROM documents WHERE doc_id % 5 = 0 HAVING count(*) > 0 UNION ALL SELECT 'invalid_nonpositive_f_number', count(*) FROM documents WHERE doc_id % 9 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'invalid_nonpositive_focal_length', count(*) FROM documents WHERE doc_id % 50 = 0 HAVING count(*) > 0""",
    "reported_diagnostics": "SELECT 'warning' AS severity, 'ExifTool:Warning' AS field_name, CASE WHEN doc_id % 4 = 0 THEN '[minor] odd' ELSE 'truncated' END AS message, count(*) AS n FROM documents GROUP BY ALL",
    "media_streams": """SELECT 'video' AS record_type, page_id AS entry, CAST(0 AS BIGINT) AS stream_index, 'h264' AS codec_name, strlen(html) AS width, CAST(NULL AS BIGINT) AS sample_rate, CAST(NULL AS DOUBLE) AS duration_seconds FROM pages
        UNION ALL SELECT 'audio', page_id, 1, 'aac', NULL, page_id % 3 * 24000, (page_id % 100) + 0.5::DOUBLE FROM pages WHERE page_id % 2 = 0""",
    "gps_points": "SELECT page_id AS entry, 0 AS point_index, (page_id % 80) + 0.5::DOUBLE AS gps_latitude, (page_id % 170) + 0.25::DOUBLE AS gps_longitude, CAST(NULL AS DOUBLE) AS gps_altitude, '+' || page_id % 80 || '.5+' || page_id % 170 || '.25/' AS raw_value FROM pages",
    "archive_listing": "SELECT CAST(page_id % 1000 AS VARCHAR) AS path, count(*) AS member_count, CAST(sum(strlen(html)) AS BIGINT) AS uncompressed_bytes, CAST(sum(page_id % 1000) AS BIGINT) AS compressed_bytes, CAST(max(CASE WHEN page_id % 9 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_encrypted FROM pages GROUP BY ALL",
    "payload_digests": """WITH p AS (SELECT page_id AS i, '{"streams":[{"codec_name":"h264","codec_type":"video","index":0,"tags":{"location":"+' || page_id % 80 || '.5+' || page_id % 170 || '.25/"},"width":' || strlen(html) || '}' || CASE WHEN page_id % 2 = 0 THEN ',{"codec_name":"aac","codec_type":"audio","duration":"' || page_id % 100 || '.5","index":1,"sample_rate":"' || page_id % 3 * 24000 || '"}' ELSE '' END || ']}' AS text FROM pages)
        SELECT i AS entry, 'streams' AS provider, sha256(text) AS payload_sha256, strlen(text) AS uncompressed_bytes FROM p""",
}
