"""Function tables of paths, numbers, times and places."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from cairn.functions import payload
from cairn.functions import text as fn


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def test_path_key(spark):
    nfc, nfd = unicodedata.normalize("NFC", "é.txt"), unicodedata.normalize("NFD", "é.txt")
    assert values(spark, fn.path_key, [nfc, nfd, "straße.txt", "STRASSE.txt", "A\\B\\C.CR3", None]) == ["é.txt", "é.txt", "strasse.txt", "strasse.txt", "a/b/c.cr3", None]
    assert values(spark, lambda c: fn.path_key(c, ascii_only=True), ["A\\B.X"]) == ["a/b.x"]


def test_names(spark):
    assert values(spark, fn.extension_of, ["a.JPG", "a", "a.b.c", ".x"]) == ["jpg", "", "c", "x"]
    assert values(spark, fn.media_kind, ["cr3", "JPEG", "psd", "mov", "xls", ""]) == ["photo_raw", "photo_jpeg", "photo_working", "video_mp4", "other", "other"]
    assert values(spark, fn.parent_path, ["", "a", "a/b/c"]) == [None, "", "a/b"]
    assert values(spark, fn.ancestors, ["", "a", "a/b/c"]) == [[""], ["", "a"], ["", "a", "a/b", "a/b/c"]]
    assert values(spark, fn.fingerprint_of_name, ["x_0A1B2C3D.sqlite", "x.sqlite", "x_2024-01-01_00-00-00.123456_0a1b2c3d.sqlite"]) == ["0A1B2C3D", None, None]
    assert values(spark, fn.is_raw_candidate, ["CR3", ".dng", "a/b.nef", "a.b/c", "jpg"]) == [True, True, True, False, False]


def test_numbers(spark):
    assert values(spark, fn.first_float, ["105.0 mm", "1/0", "n/a", "f 2.8", "6/3", None, "x -.5"]) == [105.0, None, None, 2.8, 2.0, None, -0.5]
    assert abs(values(spark, fn.first_float, ["-2/3 EV"])[0] + 2 / 3) < 1e-12
    assert values(spark, fn.first_int, ["7.9", "-7.9"]) == [7, -7]
    assert values(spark, fn.first_positive_int_pair, ["6000 4000", "0 5", "7"]) == [[6000, 4000], None, None]
    assert values(spark, fn.id_hex, [0, 255, -4591310416838365602], "long") == [None, "ff", "c048598c4a577e5e"] or values(spark, fn.id_hex, [0, 255], "long") == [None, "ff"]
    assert values(spark, fn.timeout_for_size, [0, 9 * 2**30, 9 * 2**30 + 1], "long") == [90.0, 90.0, 180.0]
    assert values(spark, fn.size_band, [0, 1, 2**20, 3 * 2**19], "long") == [0, 0, 20, 21]
    assert values(spark, fn.format_bytes, [None, 999, 1000, 1234567], "long") == ["—", "999 B", "1.00 KB", "1.23 MB"]


def test_times(spark):
    assert values(spark, fn.ns_to_utc, [0, 1000000123, -1], "long") == ["1970-01-01T00:00:00.0000000Z", "1970-01-01T00:00:01.0000001Z", "1969-12-31T23:59:59.9999999Z"]
    assert values(spark, lambda c: fn.capture_utc(c, F.lit(480)), ["2025:06:24 18:07:52", "2025:06:24 18:07:52.50", "no"]) == ["2025-06-24T10:07:52Z", "2025-06-24T10:07:52.50Z", None]
    assert values(spark, lambda c: fn.capture_utc(c, F.lit(None).cast("int")), ["2025:06:24 18:07:52"]) == [None]
    assert values(spark, fn.normalize_explicit_utc, ["2025-06-24T18:07:52.123Z", "2025-06-24T18:07:52+08:00", "2025-06-24"]) == ["2025-06-24T18:07:52.123Z", "2025-06-24T10:07:52Z", None]
    assert values(spark, fn.offset_minutes, ["+08:00", "-03:30", "08:00"]) == [480, -210, None]
    assert values(spark, lambda c: fn.matching_offset(c, F.array(F.lit("2025:06:24 18:07:52+02:00"))), ["2025:06:24 18:07:52", "2025:06:24 18:07:53"]) == [120, None]


def test_places(spark):
    found = values(spark, fn.gps_decimal, ["27 deg 16' 43.09\" N", "10 deg W", "1.5", "x"])
    assert abs(found[0] - 27.278636) < 1e-5 and found[1:] == [-10.0, None, None]  # a bare number is no text of degrees
    assert values(spark, fn.gps_decimal, [" 10.5 deg 30.0\" W", "1 deg 2 ' S", "7deg", "x deg 3'", "-1 deg", "4 deg 5' N"]) == [-(10.5 + 30 / 3600), 1.0, 7.0, None, None, 4 + 5 / 60]
    assert values(spark, fn.iso6709, ["+027+1/", "+27+1/x", "+27/", "+27+1+2+3/", "-0.5-179.25+8848.9/", ""])[:4] == [None] * 4
    found = values(spark, fn.iso6709, ["+27.278636+111.743586/", "+91+0/", "27+111/", "+1+2", "+1+2+3/"])
    assert found[0].latitude == 27.278636 and found[0].altitude is None and found[1:4] == [None, None, None] and found[4].altitude == 3


def test_damage(spark):
    said = ["File is TRUNCATED", "[minor] truncated", "Processing JPEG-like data after unknown 9-byte header", "unknown header after processing", "fine", "Bad atom size"]
    assert values(spark, fn.corrupt_warning, said) == [True, False, True, False, False, True]


def test_issues(spark):
    rows = spark.createDataFrame([("exiftool_reported_error", " Unknown  file type. "), ("exiftool_reported_error", "bad"), ("other", "unknown file type")], "c string, m string")
    assert [r[0] for r in rows.select(fn.issue_visible(F.col("c"), F.col("m"))).collect()] == [False, True, True]
    rows = spark.createDataFrame([("warning", "[minor] x"), ("warning", "File is truncated"), ("warning", "hm"), ("error", "x"), ("validation", "x"), ("x", "y")], "s string, m string")
    assert [r[0] for r in rows.select(fn.diagnostic_class(F.col("s"), F.lit("c"), F.col("m"))).collect()] == ["minor", "candidate", "warning", "need_action", "validation", "information"]
    assert values(spark, fn.normalize_family, ["Copy123", "xcopy7y"]) == ["Copy#", "xcopy#y"]


def test_disks(spark):
    assert values(spark, fn.disk_number, ["\\\\.\\PhysicalDrive3", "/dev/pd12", "/dev/sdb", "/dev/sdaa x", "?"]) == [3, 12, 1, 26, None]
    assert values(spark, lambda c: F.size(fn.smart_exit_flags(c)), [0, 3, 128], "int") == [0, 2, 1]
    assert values(spark, lambda c: fn.collection_status(c, F.lit(False)), [0, 4, 8], "int") == ["complete", "incomplete", "complete_with_warnings"]
    assert values(spark, fn.safe_component, ["a/b", " con ", "..."]) == ["a_b", "_con", "Disk"]


def test_payloads(spark):
    doc = '{"SourceFile":"x","EXIF:Main:Make":{"val":"Canon","num":1},"EXIF:Copy1:Make":"Nikon","IFD0:Model":"R5"}'
    rows = payload.tags(spark.createDataFrame([(1, doc)], "e int, payload string"), ["e"])
    found = {(r.family, r.tag): (r.value, r.number) for r in rows.collect()}
    assert found["exif", "make"] == ("Canon", "1") and found["*", "model"] == ("R5", None) and len(found) == 4
    assert values(spark, payload.canonical_json, ['{"b":1,"a":[1,2]}', "x"]) == ['{"a":[1,2],"b":1}', None]
    assert values(spark, payload.drop_volatile, ['{"System:FileAccessDate":1,"a":{"Directory":2,"k":3}}']) == ['{"a":{"k":3}}']
    kinds = values(spark, lambda c: payload.value_type(F.parse_json(c)), ["1", "1.5", "true", '"x"', "[1]", "null"])
    assert kinds == ["integer", "number", "boolean", "text", "json", "null"]
