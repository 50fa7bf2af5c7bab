"""Files, archives, journals, snapshots and exports on temporary folders."""

from __future__ import annotations

import hashlib
import io
import json
import os
import pathlib
import shutil
import sqlite3
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.plans import projections
from cairn.sources import bundle, files, journals, schemas, sqlite
from cairn.streaming import journal


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def test_tree(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.JPG").write_bytes(b"12345")
    (tmp_path / "y.txt").write_bytes(b"")
    os.symlink(tmp_path / "y.txt", tmp_path / "link")
    roots = spark.createDataFrame([("r", str(tmp_path)), ("gone", str(tmp_path / "no"))], "root_label string, root_path string")
    found = files.list_tree(roots, 2)
    assert {(r.root_label, r.rel_path, r.enum_status) for r in found["dirs"].collect()} == {("r", "", "ok"), ("r", "a", "ok"), ("r", "a/b", "ok"), ("gone", "", "io_error")}
    assert {(r.rel_path, r.media_kind, r.size) for r in found["entries"].collect()} == {("a/b/x.JPG", "photo_jpeg", 5), ("y.txt", "other", 0)}
    assert {r.root_label: r.enum_status for r in found["roots"].collect()} == {"r": "ok", "gone": "failed"}
    sums = {r.rel_path: (r.hash_hex, r.status) for r in files.digest_files(found["entries"]).collect()}
    assert sums["a/b/x.JPG"] == (hashlib.sha256(b"12345").hexdigest(), "valid")
    assert {r.hash_hex for r in files.digest_store(spark, str(tmp_path / "a")).collect()} == {hashlib.sha256(b"12345").hexdigest()}


def test_tasks_by_bytes(spark):
    """A huge file beside thousands of small ones, a volume of nothing but empty files: tasks have about as many bytes, and a volume has no more tasks than it may."""
    rows = [("r", f"a/{k:05}", 1000, "v1") for k in range(3000)] + [("r", "a/00500x", 5_000_000, "v1")] + [("r", f"e/{k}", 0, "v2") for k in range(50)] + [("s", "x", None, None), ("s", "y", 10, "")]
    entries = spark.createDataFrame(rows, "root_label string, rel_path string, size long, volume string")
    found = files.packed_tasks(entries, 100_000, 20).collect()
    by_task, of_volume = {}, {}
    for r in found:
        by_task.setdefault(r.task, []).append(r.size or 0)
        of_volume.setdefault(r.volume or r.root_label, set()).add(r.task)
    assert len(found) == len(rows) and {k: len(x) for k, x in of_volume.items()} == {"v1": len(of_volume["v1"]), "v2": 1, "s": 1} and len(of_volume["v1"]) <= 20
    width = -(-8_000_000 // 20)
    assert all(sum(x) <= width + max(x) for x in by_task.values()) and [len(x) for x in by_task.values() if max(x) == 5_000_000][0] <= width / 1000 + 1
    assert not set.intersection(of_volume["v1"], of_volume["v2"]) and len({r.task for r in files.packed_tasks(entries.where("volume = 'v1'"), 1_000_000_000).collect()}) == 1
    assert files.packed_tasks(entries.where("false")).count() == 0


def test_archives(spark):
    good = packed(a="x" * 100)
    bad = bytearray(good)
    bad[40] ^= 255
    rows = spark.createDataFrame([("good", bytearray(good)), ("bad", bad), ("cut", bytearray(good[:30])), ("ole", bytearray(files.OLE_MAGIC + b"x"))], "path string, content binary")
    assert {r.path: r.v for r in rows.select("path", files.validate_zip("content").alias("v")).collect()} == {"good": "valid", "bad": "invalid", "cut": "invalid", "ole": "unsupported"}
    assert [(r.member_path, r.size_bytes) for r in files.zip_members(rows.where("path = 'good'")).collect()] == [("a", 100)]
    pdf = b"%PDF-1.7 ..." + b"x" * 5000 + b"startxref 1 %%EOF"
    rows = spark.createDataFrame([(bytearray(pdf),), (bytearray(pdf[:-5]),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in rows.select(files.validate_pdf(F.col("c"))).collect()] == ["valid", "invalid", "invalid"]
    text = "7-Zip\n----------\nPath = a/b\nSize = 10\nPacked Size = 4\nAttributes = A\nCRC = AABB\nEncrypted = -\n\nPath = d\nFolder = +\nSize = 0\nEncrypted = +\n"
    members = files.listing_members(spark.createDataFrame([("l", text)], "path string, text string"))
    assert sorted((r.member_index, r.member_path, r.is_dir, r.size_bytes, r.crc32_hex, r.encrypted) for r in members.collect()) == [(0, "a/b", 0, 10, "aabb", 0), (1, "d", 1, 0, None, 1)]
    assert tuple(files.archive_totals(members).first())[1:] == (2, 10, 4, 1)


def test_profiles(spark):
    manifest = json.dumps({"files": [{"name": "d.json", "size": 2}]})
    data = packed(**{"d.json": "{}", "manifest.json": manifest})
    wrong = packed(**{"d.json": "{}", "e.json": "", "manifest.json": manifest})
    name = lambda d: f"/x/disk_{hashlib.sha256(d).hexdigest()[:8].upper()}.zip"
    rows = spark.createDataFrame([(name(data), bytearray(data)), (name(wrong), bytearray(wrong)), ("/x/disk_00000000.zip", bytearray(data))], "path string, content binary")
    assert sorted(r.verdict for r in files.profile_verdicts(rows).collect()) == ["fingerprint_differs", "members_differ", "valid"]


def test_journal(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"event":"a"}\n{"event":"b"}\n{"eve')
    assert [r.event for r in journals.read_journal(spark, str(path)).collect()] == ["a", "b"]
    path.write_text('{"event":"a"}\n{"eve\n{"event":"b"}\n')
    with pytest.raises(ValueError):
        journals.read_journal(spark, str(path))
    for part, text in (("a", '{"event":"a"}\n'), ("b", '{"event":"b"}\n{"eve' + "x" * 200_000), ("c", "")):  # like-named files, a long last line, an empty file
        (tmp_path / f"d/day={part}").mkdir(parents=True)
        (tmp_path / f"d/day={part}/j.jsonl").write_text(text)
    assert sorted(r.event for r in journals.read_journal(spark, str(tmp_path / "d")).collect()) == ["a", "b"]
    (tmp_path / "d/day=a/j.jsonl").write_text('{"event":"a"}\n{"eve\n')
    with pytest.raises(ValueError):
        journals.read_journal(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1, 1, "valid", 5, 5, None), (1, 2, "valid", 0, 5, None), (2, 1, "unsupported", None, None, None)], "entry long, sequence long, status string, width long, height long, path string")
    assert sorted((r.entry, r.sequence) for r in journals.decode_records(rows).collect()) == [(1, 1), (2, 1)]
    flat = spark.createDataFrame([('{"a":{"b":{"c":1}},"d":2}',)], "t string").select(F.explode(journals.flat_counts(F.col("t"))).alias("x"))
    assert sorted((r.x.key, r.x.value) for r in flat.collect()) == [("a.b.c", "1"), ("d", "2")]


def test_any_depth(spark):
    deep = "1"
    for k in range(25):
        deep = f'{{"k{k}":{deep},"x{k}":[{k},{{"y":1}}]}}'
    rows = spark.createDataFrame([(1, deep), (2, '{"a":"{}","b":null,"c":{},"d":true}'), (3, "no json"), (4, "[1]"), (5, None), (6, "{}")], "id long, t string")
    found = {(r.id, r.key): r.value for r in journals.flat_rows(rows, "t", ["id"]).collect()}
    assert found[1, ".".join(f"k{k}" for k in reversed(range(25)))] == "1" and found[1, "x24"] == '[24,{"y":1}]' and sum(k[0] == 1 for k in found) == 26
    assert {k[1]: v for k, v in found.items() if k[0] == 2} == {"a": "{}", "b": None, "d": "true"} and {k[0] for k in found} == {1, 2}
    few = {(r.id, r.key) for r in journals.flat_rows(rows, "t", ["id"], 2).collect()}
    assert (1, "k24.k23") in few and len([x for x in few if x[0] == 1]) == 3


def test_export_in_one_pass(spark, tmp_path):
    """Rows, their digest and the files come from one run over the input."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(500, numPartitions=3).mapInPandas(count, "id long")
    row = projections.export_module(df, str(tmp_path / "m"), "files", "csv", "snap_0A").first()
    assert seen.value == 500 and (row.rows, row.n_files, row.input_identity, row.fields) == (500, 3, "snap_0A", ["id"])
    again = projections.export_module(spark.range(500, numPartitions=1), str(tmp_path / "n"), "files", "jsonl").first()
    other = projections.export_module(spark.range(1, 501), str(tmp_path / "o"), "files", "csv").first()
    assert again.rows_digest == row.rows_digest != other.rows_digest and again.input_identity is None
    empty = projections.export_module(spark.range(0), str(tmp_path / "p"), "files", "csv", warnings=["w"]).first()
    assert empty.rows == 0 and empty.warnings == ["w"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.jsonl").write_text('{"event":"a"}\nbroken\n')
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    journal.journal_stream(spark, str(tmp_path / "in"), good, bad, str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/2.jsonl").write_text('{"event":"b"}\n')
    journal.journal_stream(spark, str(tmp_path / "in"), good, bad, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.event for r in spark.read.parquet(good).collect()) == ["a", "b"] and spark.read.parquet(bad).count() == 1
    rows = spark.createDataFrame([(e, "hash", n, f"s{n}", f"2024-01-0{n}") for e in (1, 2) for n in (1, 3, 2)], "entry long, stage string, attempt_number long, status string, day string").withColumn("ts", F.to_timestamp("day")).withColumn("event_type", F.col("stage")).withColumn("value", F.lit(1.0))
    rows.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "events")).schema).parquet(str(tmp_path / "events"))
    for name, make in (("latest", journal.latest_attempts), ("rollup", journal.event_rollup)):
        make(stream).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, make(rows).collect()))
    journal.distinct_events(stream, ["entry", "stage"], "10 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == journal.distinct_events(rows, ["entry", "stage"]).count() == 2


def snapshot(spark, **more):
    make = lambda name, rows: spark.createDataFrame([tuple(({} | r).get(c.split(" ")[0]) for c in schemas.TABLES[name].split(", ")) for r in rows], schemas.TABLES[name])
    entry = {"root_label": "r", "rel_path": "a", "path_key": "a", "size_bytes": 1, "is_placeholder": 0, "meta_status": "done", "hash_status": "done"} | more
    return {"snapshot_info": make("snapshot_info", [{"snapshot_uuid": "u", "status": "complete"}]), "roots": make("roots", [{"root_label": "r", "enum_status": "ok"}]), "entries": make("entries", [entry]), "hashes": make("hashes", [{"root_label": "r", "rel_path": "a", "algorithm": "sha256", "origin": "computed", "status": "valid", "hash_hex": "h"}])}


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "snap")
    stem = path
    path = bundle.publish_snapshot(snapshot(spark), stem)
    assert path == f"{stem}_{bundle.fingerprint(spark, path)}" and len(path) == len(stem) + 9
    with pytest.raises(Exception, match="(?i)exists"):
        bundle.publish_snapshot(snapshot(spark), stem)
    read = bundle.read_snapshot(spark, path, ["entries", "hashes"])
    assert read["entries"].first().rel_path == "a"
    manifest = projections.file_manifest(read["entries"], read["hashes"]).first()
    assert (manifest.logical_path, manifest.hash_hex) == ("r\\a", "h")
    assert set(bundle.read_snapshot(spark, path, verify=True)) == {"snapshot_info", "roots", "entries", "hashes"}
    with pytest.raises(ValueError):
        bundle.publish_snapshot(snapshot(spark, hash_status="pending"), str(tmp_path / "other"))
    damaged = pathlib.Path(bundle.publish_snapshot(snapshot(spark), str(tmp_path / "damaged")))
    next((damaged / "roots").glob("part-*")).unlink()
    assert bundle.check_folder(spark, str(damaged)) == ["roots"]
    with pytest.raises(ValueError):
        bundle.read_snapshot(spark, str(damaged), verify=True)
    with pytest.raises(ValueError, match="fingerprint"):
        bundle.read_snapshot(spark, str(shutil.copytree(path, tmp_path / "snap_00000000")), verify=True)
    with pytest.raises(ValueError):
        bundle.read_snapshot(spark, path, ["dirs"])
    broken = snapshot(spark, size_bytes=-1, root_label="q")
    assert {(r.table, r.rule) for r in bundle.constraint_violations(broken).where("n > 0").collect()} == {("entries", "size"), ("entries", "in roots"), ("hashes", "in entries")}
    before = bundle.directory_digest(spark, path)
    assert bundle.input_unchanged(before, bundle.directory_digest(spark, path))
    states = {r.capability: r.state for r in bundle.capabilities(spark, {"a": spark.range(3), "b": spark.range(0), "d": spark.range(0)}, {"a": ["id"], "b": ["id"], "c": ["id"], "a2": [], "d": ["id"]}, {"d": "not executed"}).collect()}
    assert states == {"a": "available", "b": "empty", "c": "unavailable", "a2": "unavailable", "d": "unavailable"}


def test_publishing_in_two_phases(spark, tmp_path):
    """A try that fails between tables leaves nothing; the next one publishes tables, manifest and events under one name."""
    stem = str(tmp_path / "two")
    good = bundle.described(snapshot(spark) | {"dirs": spark.createDataFrame([("r", "", "", "ok", None, 1, 0, 0, None)], schemas.TABLES["dirs"])})
    fails = good["hashes"].withColumn("hash_hex", F.when(F.col("status") == "valid", F.raise_error(F.lit("the disk is full")).cast("string")))
    with pytest.raises(Exception, match="disk is full"):
        bundle.publish_snapshot(good | {"hashes": fails}, stem)
    assert os.listdir(tmp_path) == [] and bundle.published_as(spark, stem) == []
    (tmp_path / "two.partial-1").mkdir()  # of a driver that was lost
    events = spark.createDataFrame([('{"event":"start","ts":"2024-01-01","root":"r"}', "start"), ('{"event":"end","ts":"2024-01-02"}', "end")], "value string, event string")
    path = bundle.publish_snapshot(good, stem, events, {"host": "h"})
    found = bundle.read_evidence(spark, path)
    assert [(r.event_seq, r.event, json.loads(r.payload_json).get("root")) for r in found["run_events"].orderBy("event_seq").collect()] == [(1, "start", "r"), (2, "end", None), (3, "snapshot_sealed", None)]
    document = json.loads(found["snapshot_manifest"].first().manifest_json)
    assert document["root_labels"] == ["r"] and document["counts"]["total.entries"] == 1 and document["events"]["count"] == 3 and json.loads(document["run"]) == {"host": "h"}
    assert bundle.read_snapshot(spark, path, verify=True)["entries"].count() == 1
    assert bundle.clear_partial(spark, stem) == 1 and [os.path.basename(path)] == os.listdir(tmp_path)


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "s.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL, p BLOB)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, f"n{i}", i / 2, zlib.compress(b'{"a":1}')) for i in range(10)])
    df = sqlite.table(spark, path, "t", rows=3)
    assert df.count() == 10 and df.where("id < 3").count() == 3 and df.count() == 10
    assert {r[0] for r in df.select(files.inflate("p")).collect()} == {'{"a":1}'}
    few = sqlite.table(spark, path, "t", ["name", "x"], "x >= 3.5 and name <> 'n9'", rows=3)
    assert sorted(r.name for r in few.collect()) == ["n7", "n8"] and few.columns == ["name", "x"]


def test_sqlite_reads_what_is_asked(tmp_path):
    """Pushed filters and columns are in the statement; tables without row numbers and sparse ones are cut to parts of the size."""
    path = str(tmp_path / "s.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE w (a TEXT, b INTEGER, c TEXT, PRIMARY KEY (a, b)) WITHOUT ROWID")
        con.executemany("INSERT INTO w VALUES (?, ?, ?)", [(f"k{i % 3}", i, "c") for i in range(100)])
        con.execute("CREATE TABLE sparse (id INTEGER PRIMARY KEY, v TEXT)")
        con.executemany("INSERT INTO sparse VALUES (?, ?)", [(i**6, "v") for i in range(50)])
        con.execute("CREATE TABLE none (id INTEGER PRIMARY KEY)")
    made = sqlite.SqliteReader({"path": path, "table": "w", "rows": "7"}, ["b", sqlite.FILE])
    filters = [sqlite.EqualTo(("a",), "k1"), sqlite.GreaterThan(("b",), 50), sqlite.In(("c",), ("c", "d")), sqlite.IsNotNull(("b",)), sqlite.EqualTo((sqlite.FILE,), "x")]
    assert list(made.pushFilters(filters)) == filters  # Spark looks again
    parts = made.partitions()
    text, values = made.statement(parts[1])
    assert text.startswith('SELECT "b" FROM "w" WHERE') and values[:4] == ["k1", 50, "c", "d"] and len(parts) == 15
    assert sorted(r for p in parts for r in made.read(p)) == [(i, path) for i in range(51, 100) if i % 3 == 1]
    for name, n, most in (("sparse", 50, 8), ("none", 0, 1)):
        reader = sqlite.SqliteReader({"path": path, "table": name, "rows": "7"}, ["id"])
        assert sum(1 for p in reader.partitions() for _ in reader.read(p)) == n and len(reader.partitions()) <= most


def test_import(spark, tmp_path):
    """Rows of entries, of directories and of roots; numbers mean something in their file only."""
    for k in (1, 2):
        with sqlite3.connect(str(tmp_path / f"{k}.sqlite")) as con:
            con.executescript(f"""CREATE TABLE snapshot_info (id INTEGER PRIMARY KEY, snapshot_uuid TEXT, scan_status TEXT, path_key_rule INTEGER); INSERT INTO snapshot_info VALUES (1, 'u', 'complete', 1);
                CREATE TABLE roots (root_id INTEGER PRIMARY KEY, root_label TEXT, enum_status TEXT); INSERT INTO roots VALUES ({3 - k}, 'r', 'ok'), ({k}, 's', 'ok');
                CREATE TABLE dirs (dir_id INTEGER PRIMARY KEY, root_id INTEGER, rel_path TEXT, path_key TEXT, enum_status TEXT); INSERT INTO dirs VALUES (1, {3 - k}, 'd{k}', 'd{k}', 'ok');
                CREATE TABLE entries (entry_id INTEGER PRIMARY KEY, root_id INTEGER, rel_path TEXT, path_key TEXT, size_bytes INTEGER); INSERT INTO entries VALUES (1, {3 - k}, 'a{k}', 'a{k}', {k}), (2, {k}, 'b{k}', 'b{k}', 9);
                CREATE TABLE hashes (entry_id INTEGER, algorithm TEXT, hash_hex TEXT, PRIMARY KEY (entry_id, algorithm)) WITHOUT ROWID; INSERT INTO hashes VALUES (2, 'sha256', 'h{k}');
                CREATE TABLE errors (error_pk INTEGER PRIMARY KEY, entry_id INTEGER, dir_id INTEGER, error_code TEXT); INSERT INTO errors VALUES (1, 1, NULL, 'x'), (2, NULL, 1, 'y'), (3, NULL, NULL, 'z');""")
    found = sqlite.import_snapshot(spark, str(tmp_path), rows=1)
    rows = lambda t, *c: sorted((tuple(r) for r in found[t].select(*c).collect()), key=str)
    assert set(found) == {"snapshot_info", "roots", "dirs", "entries", "hashes", "errors"}
    assert rows("snapshot_info", "snapshot_uuid", "status") == [("u", "complete")] and rows("roots", "root_label") == [("r",), ("s",)]
    assert rows("entries", "root_label", "rel_path", "size_bytes") == [("r", "a1", 1), ("r", "a2", 2), ("s", "b1", 9), ("s", "b2", 9)]
    assert rows("hashes", "root_label", "rel_path", "hash_hex") == [("s", "b1", "h1"), ("s", "b2", "h2")]
    assert rows("errors", "root_label", "rel_path", "is_dir", "error_code")[:4] == [("r", "a1", 0, "x"), ("r", "a2", 0, "x"), ("r", "d1", 1, "y"), ("r", "d2", 1, "y")]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a long, b string")
    projections.export_csv(df.coalesce(1), str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert text.startswith(b"a,b\n1,\xc3\xa9\n")
    projections.export_jsonl(df.coalesce(1), str(tmp_path / "j"), "c1", "db", "m")
    assert json.loads(next((tmp_path / "j").glob("part-*")).read_text().split("\n")[1]) == {"contract": "c1", "database": "db", "module_id": "m", "record": {"a": 2, "b": None}}
    row = projections.export_manifest(df, str(tmp_path / "c")).first()
    assert row.sha256 == hashlib.sha256(text).hexdigest() and row.bytes == len(text)
    projection = projections.business_projection({"t": (df, ["a"], [])})
    assert projections.business_digest(projection).collect() == projections.business_digest(projection.repartition(3)).collect()
    both = projections.union_shaped({"x": df.select("a"), "y": df.select("b")})
    assert both.columns == ["record_type", "a", "b"] and both.count() == 4
    assert projections.overview(df.limit(1), spark.createDataFrame([("s", "k", 3)], "section string, key string, value long")).count() == 3


def test_files_of_published_tables(spark, tmp_path):
    """Tasks don't each write a file for every root, and the manifest says of each table what its own digest does."""
    good = snapshot(spark)
    many = spark.range(400).select(F.concat(F.lit("r"), (F.col("id") % 5).cast("string")).alias("root_label"), F.col("id").cast("string").alias("rel_path")).repartition(8)
    names = [c.split(" ") for c in schemas.TABLES["hashes"].split(", ")]
    hashes = many.select(*[(F.col(n) if n in many.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names])
    path = bundle.publish_snapshot(good | {"hashes": hashes, "errors": good["entries"].select("root_label", "rel_path").where("false")}, str(tmp_path / "with space"))
    assert len(list(pathlib.Path(path).glob("hashes/*/*.parquet"))) == 5
    told = {r.table: (r.files, r.bytes, r.digest) for r in bundle.stored_tables(spark, path).collect()}
    assert told["hashes"][0] == 5 and told["errors"] == (0, 0, None)
    for name in ("entries", "hashes", "roots", "run_events"):
        assert told[name] == tuple(bundle.directory_digest(spark, f"{path}/{name}").first())
    bundle.read_snapshot(spark, path, ["entries", "hashes"], verify=True)


def test_files_of_imported_snapshots(spark, monkeypatch):
    """A larger snapshot goes through more SQLite files, not through larger ones."""
    from cairn.plans import bundle_queries

    seen = []
    export = sqlite.export_snapshot
    monkeypatch.setattr(bundle_queries, "FILE_ENTRIES", 20)
    monkeypatch.setattr(sqlite, "export_snapshot", lambda own, folder, files: (seen.append(files), export(own, folder, files))[1])
    found = bundle_queries.imported(spark, "/root/testdata/sf0.001", False)
    n = found["entries"].count()
    assert n > 150 and seen == [-(-n // 20)]
