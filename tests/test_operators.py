"""History, statistics, reconciliation, verification, issues, metadata and disks on small tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cairn.functions.payload import tag_map, tags
from cairn.operators import disks, history, issues, metadata, ranking, reconcile, stats, verify


def test_ranked_hot_groups(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7) % 1000).alias("v"))
    plain = {(r.k, r.v): r.rank for r in ranking.ranked(df, "k", ["v"]).collect()}
    monkeypatch.setattr(ranking, "GROUP_ROWS", 10)
    assert {(r.k, r.v): r.rank for r in ranking.ranked(df, "k", ["v"]).collect()} == plain


def test_sample(spark):
    df = spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 500).alias("size"))
    first = {r.key for r in ranking.stratified_sample(df, "size", "key", 1, 100, "s").collect()}
    again = {r.key for r in ranking.stratified_sample(df.repartition(7), "size", "key", 1, 100, "s").collect()}
    other = {r.key for r in ranking.stratified_sample(df, "size", "key", 1, 100, "t").collect()}
    assert len(first) == 100 and first == again and first != other
    assert {int((k % 500) * 2 // 250) for k in first} == {0, 1, 2, 3}
    assert ranking.stratified_sample(df, "size", "key", 1, 5000, "s").count() == 1000


def test_runs(spark):
    rows = [("t", i, x) for i, x in enumerate("aabbb.bbb")]
    df = spark.createDataFrame(rows, "tool string, n int, s string")
    sig = F.when(F.col("s") != ".", F.col("s"))
    assert sorted((r.signature, r.length, r.first) for r in history.failure_runs(df, "tool", ["n"], sig).collect()) == [("b", 3, 2), ("b", 3, 6)]
    cut = history.circuit_breaker(df, "tool", ["n"], sig).first()
    assert (cut.signature, cut.processed, cut.not_processed) == ("b", 5, 4)


def test_recovery(spark):
    a = spark.createDataFrame([(1, "hash", 1, "running")], "entry long, stage string, attempt_number long, status string")
    c = spark.createDataFrame([(1, "hash", "processing")], "entry long, stage string, status string")
    s = spark.createDataFrame([("hash", "running")], "stage string, status string")
    found = history.recover_interrupted(a, c, s)
    assert [found[k].first()["status"] for k in ("attempts", "current", "stages")] == ["abandoned", "pending", "failed_recoverable"]
    assert [r.status for r in history.apply_attempts(c, found["attempts"]).collect()] == ["pending"]


def test_outliers(spark):
    rows = [(i, "g", 1 << 20, 1 << 20, 1.0, 0.0) for i in range(8)] + [(8, "g", 1 << 20, 1 << 20, 5.0, 0.0), (9, "h", 1 << 20, 1 << 20, 1.0, 31.0), (10, "h", 1 << 20, 1 << 20, 1.0, 90.0)]
    found = {r.id: (r.confidence, r.reason) for r in stats.outliers(spark.createDataFrame(rows, "id long, group string, size long, bytes_read long, seconds double, longest_stall double")).collect()}
    assert found[0] == ("none", None) and found[8] == ("high", "slow_in_group") and found[9] == ("low", "stalled") and found[10] == ("high", "stalled")


def test_reconcile(spark):
    kinds = "k string, size long, m string, h string"
    old = spark.createDataFrame([("a", 1, "done", "done"), ("b", 1, "done", "done"), ("c", 1, "done", "error")], kinds)
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "k string, size long")
    found = {r.k: (r.size, r.m, r.h, r.change) for r in reconcile.reconcile(old, new, ["k"], ["size"], ["m", "h"]).collect()}
    assert found == {"a": (1, "done", "done", "kept"), "b": (2, "pending", "pending", "updated"), "c": (1, "done", "error", "removed"), "d": (1, "pending", "pending", "inserted")}


def test_reuse(spark):
    kinds = "root_label string, path_key string, size long, mtime long, placeholder boolean, volume_serial string, file_index_hex string"
    now = spark.createDataFrame([("r", p, 1, 1, False, "v", "1") for p in "abcde"], kinds)
    before = spark.createDataFrame([("r", "a", 1, 1, False, "v", "1", "h"), ("r", "b", 2, 1, False, "v", "1", "h"), ("r", "c", 1, 1, False, "v", "2", "h"), ("r", "d", 1, 1, False, None, None, "h"), ("r", "d", 1, 1, False, None, None, "h")], kinds + ", hash_hex string")
    plan = {r.path_key: (r.reuse, r.basis) for r in reconcile.reuse_plan(now, before).collect()}
    assert plan == {"a": (True, "size+mtime+fileid"), "b": (False, "stat_changed"), "c": (False, "file_id_mismatch"), "d": (False, "ambiguous_path_key"), "e": (False, "no_previous_entry")}


def test_guards(spark):
    of = lambda bad, n: spark.createDataFrame([("error",)] * bad + [("done",)] * (n - bad), "hash_status string")
    assert [reconcile.error_rate_guard(of(b, n)) for b, n in ((10, 19), (4, 20), (5, 20), (11, 20))] == ["ok", "ok", "warn", "abort"]
    sample = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 1, 1), ("c", "h", 1, 1)], "key string, hash_hex string, size long, mtime long")
    again = spark.createDataFrame([("a", "h", "h", 1, 1), ("b", "x", "x", 1, 1), ("c", "x", "x", 2, 1)], "key string, first string, second string, size long, mtime long")
    assert {r.key: r.outcome for r in reconcile.independent_verify(sample, again).collect()} == {"a": "matched", "b": "verify_mismatch", "c": "verify_source_changed"}


def test_verify(spark):
    verdicts = spark.createDataFrame([("media", "Error : bad", 0), ("media", "Warning : [minor] truncated", 0), ("media", "Warning : File is truncated", 0), ("7z", "Wrong password", 2), ("7z", "x", 2), ("none", None, 0)], "k string, t string, e int")
    assert [r[0] for r in verdicts.select(verify.tool_verdict(F.col("k"), F.col("t"), F.col("e"), F.lit(None).cast("int"))).collect()] == ["invalid", "valid", "invalid", "unsupported", "invalid", "unsupported"]
    groups = verify.tool_failure_groups(spark.createDataFrame([("s", p) for p in "dcba"] + [("t", "z")], "signature string, path string"))
    assert {r.signature: (r.affected, r.samples) for r in groups.collect()} == {"s": (4, ["a", "b", "c"]), "t": (1, ["z"])}
    sections = lambda *x: spark.createDataFrame([x], "failed boolean, stopped boolean, issues long, unavailable boolean, unverifiable long")
    assert [verify.conclusion(sections(*x)).first()[0] for x in ((True, True, 1, True, 1), (False, True, 1, True, 1), (False, False, 1, True, 1), (False, False, 0, False, 2), (False, False, 0, False, 0))] == ["failed", "stopped", "issues_found", "incomplete", "passed"]


def test_sections(spark):
    entries = spark.createDataFrame([(1, "done", "done"), (2, "done", "error"), (3, "error", "done")], "entry long, meta_status string, hash_status string")
    errors = spark.createDataFrame([], "entry long, stage string")
    tried = spark.createDataFrame([(1, "hash", "timeout")], "entry long, stage string, status string")
    assert tuple(issues.hash_section(entries, errors, tried).first()) == (2, 2)
    assert tuple(issues.hash_section(entries, errors, tried, executed=False).first()) == (None, None)
    diag = spark.createDataFrame([(1, 1, "error", "exiftool_reported_error", "Unknown file type"), (3, 2, "error", "Copy123", "JPEG format error")] + [(2, 9 + i, "warning", "w", "[minor] x") for i in range(100)], "entry long, diagnostic_pk long, severity string, diagnostic_code string, message string")
    found = {r.entry: (r.level, r.message) for r in issues.metadata_section(entries, diag).collect()}
    assert found == {3: ("need_action", "JPEG format error"), 2: ("candidate", "[minor] x")}
    many = spark.range(500).select(F.lit("s").alias("section"), "id")
    top = issues.capped(many, "section", F.col("id").desc(), limit=10).collect()
    assert sorted(r.id for r in top) == list(range(490, 500)) and {r.total for r in top} == {500}


def test_metadata(spark):
    doc = {"IFD0:Make": "Canon", "IFD0:Model": "R5", "ExifIFD:DateTimeOriginal": "2025:06:24 18:07:52", "ExifIFD:OffsetTimeOriginal": "+08:00", "ExifIFD:FNumber": {"val": "0", "num": 0}, "ExifIFD:LensSerialNumber": "0000", "File:ImageWidth": 6000, "Composite:GPSLatitude": {"val": "0", "num": 0}, "Composite:GPSLongitude": {"val": "0", "num": 0}, "ExifTool:Warning": "[minor] x", "ExifTool:Copy1:Error": ["a", "b"]}
    raw = spark.createDataFrame([(1, json.dumps(doc))], "entry long, payload string")
    rows = tag_map(tags(raw, ["entry"]), ["entry"]).withColumn("extension", F.lit("cr3"))
    photo = metadata.photo(rows).first()
    assert (photo.camera_model, photo.capture_time_utc, photo.f_number, photo.lens_serial, photo.width, photo.gps_latitude) == ("R5", "2025-06-24T10:07:52Z", None, None, 6000, None)
    assert {r.diagnostic_code for r in metadata.validation(rows).collect()} == {"invalid_all_zero_lens_serial", "invalid_nonpositive_f_number", "invalid_zero_gps_placeholder"}
    assert sorted((r.severity, r.message) for r in metadata.reported(raw).collect()) == [("error", "a"), ("error", "b"), ("warning", "[minor] x")]
    assert metadata.working(rows).count() == metadata.document(rows).count() == 1


def test_streams(spark):
    doc = {"streams": [{"index": 0, "codec_type": "video", "codec_name": "h264", "width": 10, "height": 5, "bit_rate": "100", "tags": {"timecode": "01:00"}}, {"index": 1, "codec_type": "audio", "codec_name": "aac", "sample_rate": "48000"}], "format": {"format_name": "mov", "duration": "2.5", "tags": {"creation_time": "2025-06-24T10:00:00Z", "LOCATION": "+1.5+2.5+3/"}}}
    raw = spark.createDataFrame([(1, json.dumps(doc)), (2, '{"streams":[]}')], "entry long, payload string")
    assert [(r.codec_name, r.width) for r in metadata.streams(raw, "video").collect()] == [("h264", 10)]
    audio = metadata.streams(raw, "audio")
    tagged = spark.createDataFrame([(2, {"file:filetype": ("AAC", None), "*:duration": ("3 s", "3")})], "entry long, tags map<string,struct<value:string,number:string>>")
    assert sorted((r.entry, r.codec_name) for r in metadata.audio_fallback(audio, tagged).collect()) == [(1, "aac"), (2, "aac")]
    film = {r.entry: r for r in metadata.audio_video(tagged, raw).collect()}
    assert (film[1].container_format, film[1].duration_seconds, film[1].timecode, film[1].capture_time_utc) == ("mov", 2.5, "01:00", "2025-06-24T10:00:00Z")
    assert film[2].container_format == "aac"
    assert [(r.point_index, r.gps_latitude) for r in metadata.gps_points(raw).collect()] == [(0, 1.5)]
    entries = spark.createDataFrame([(1, "audio", 100), (2, "audio", 100)], "entry long, media_kind string, size long")
    assert [(r.entry, r.diagnostic_code) for r in metadata.av_validation(entries, raw).collect()] == [(2, "media_no_streams")]
    outcomes = spark.createDataFrame([(1, "done"), (1, "timeout"), (2, "done")], "entry long, outcome string")
    assert {r.entry: r.meta_status for r in metadata.meta_status(outcomes).collect()} == {1: "timeout", 2: "done"}


def test_disk_layout(spark):
    parts = spark.createDataFrame([(0, 100000, 4000000), (1, 0, 10), (1, 20, 10), (1, 5, None)], "disk long, offset long, size long")
    size = spark.createDataFrame([(0, 4100000), (1, 50), (2, 7), (3, None)], "disk long, size long")
    assert sorted(tuple(r) for r in disks.layout_gaps(parts, size).collect()) == [(0, "leading", 0, 100000), (1, "inter_partition", 10, 10), (1, "trailing", 30, 20), (2, "trailing", 0, 7)]
    a = spark.createDataFrame([(1, 5, "u", "s"), (2, 5, "u", "s")], "disk long, size long, unique_id string, serial string")
    b = spark.createDataFrame([(1, 6, "u", "t"), (3, 5, "u", "s")], "disk long, size long, unique_id string, serial string")
    assert {r.disk: r.drift for r in disks.same_disk(a, b).collect()} == {1: ["size", "serial"], 2: ["gone"], 3: ["new"]}
