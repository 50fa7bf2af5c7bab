"""Working folders: only touched roots are written, steps may be done again, attempts end once."""

from __future__ import annotations

import pathlib

import pytest
from pyspark.sql import functions as F

from cairn.sources import schemas, working


def table(spark, name, rows):
    names = [c.split(" ")[0] for c in schemas.TABLES[name].split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.TABLES[name])


def entry(root, path, size=1, **more):
    return {"root_label": root, "rel_path": path, "path_key": path, "name": path, "size_bytes": size, "modified_at_utc": "t", "meta_status": "done", "hash_status": "done"} | more


def made(spark, path, **more):
    entries = [entry("a", "x"), entry("a", "y"), entry("b b/=", "x"), entry("c", "z")]
    tables = {
        "snapshot_info": table(spark, "snapshot_info", [{"snapshot_uuid": "u", "status": "complete"}]),
        "dirs": table(spark, "dirs", [{"root_label": r, "rel_path": "", "path_key": "", "enum_status": "ok"} for r in ("a", "b b/=", "c")]),
        "entries": table(spark, "entries", entries),
        "hashes": table(spark, "hashes", [{"root_label": e["root_label"], "rel_path": e["rel_path"], "algorithm": "sha256", "hash_hex": "h"} for e in entries]),
    } | more
    working.create(tables, path)


def rows(spark, path, name, *columns):
    return sorted(tuple(r) for r in working.read(spark, path, [name])[name].select(*columns).collect())


def files_of(path, name):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path, name).rglob("*.parquet")}


def test_reconcile(spark, tmp_path):
    path = str(tmp_path / "w")
    made(spark, path)
    before = files_of(path, "entries")
    listed = {
        "dirs": table(spark, "dirs", [{"root_label": r, "rel_path": "", "path_key": "", "enum_status": "ok"} for r in ("a", "b b/=", "c")]),
        "entries": table(spark, "entries", [entry("a", "x"), entry("a", "y", 2), entry("a", "new"), entry("c", "z")]).drop("meta_status", "hash_status"),
    }
    for changes in (working.reconcile(spark, path, listed), working.reconcile(spark, path, listed)):  # the second time nothing changes
        assert rows(spark, path, "entries", "root_label", "rel_path", "size_bytes", "hash_status") == [("a", "new", 1, "pending"), ("a", "x", 1, "done"), ("a", "y", 2, "pending"), ("c", "z", 1, "done")]
        assert rows(spark, path, "hashes", "root_label", "rel_path") == [("a", "x"), ("a", "y"), ("c", "z")]
    assert {(r.change, r.n) for r in changes.where("table = 'entries'").collect()} == {("kept", 3), ("kept", 1)}
    after = files_of(path, "entries")
    assert {k: v for k, v in before.items() if "=c/" in k} == {k: v for k, v in after.items() if "=c/" in k} and not any("b b" in k or "b%20b" in k for k in after)
    assert working.check_keys(spark, path, ["entries", "dirs"]) == {"entries": 0, "dirs": 0}


def test_attempts(spark, tmp_path):
    path = str(tmp_path / "w")
    attempt = lambda root, rel, k, stage, n, status="running": {"root_label": root, "rel_path": rel, "attempt_id": k, "stage": stage, "attempt_number": n, "status": status, "session_id": "s"}
    tries = [attempt("a", "x", 1, "hash", 1), attempt("a", "x", 2, "hash", 2), attempt("a", "y", 3, "metadata", 1), attempt("c", "z", 4, "hash", 1), attempt("c", "z", 5, "hash", 2, "succeeded")]
    made(spark, path, entry_attempts=table(spark, "entry_attempts", tries), read_performance=table(spark, "read_performance", []), format_checks=table(spark, "format_checks", []))
    end = lambda *x: spark.createDataFrame([(*r, "t9", (7, 1.5) if r[2] == 2 else None) for r in x], "root_label string, rel_path string, attempt_id long, status string, ended_at_utc string, performance struct<bytes_read:bigint,elapsed_seconds:double>")
    before = files_of(path, "entries")
    for wrong in ((("c", "z", 5, "failed"),), (("a", "x", 99, "failed"),), (("a", "x", 1, "running"),), (("a", "x", 1, "failed"), ("a", "x", 1, "failed"))):
        with pytest.raises(ValueError):
            working.finish_attempts(spark, path, end(*wrong))
    assert files_of(path, "entries") == before
    done = working.finish_attempts(spark, path, end(("a", "x", 1, "succeeded"), ("a", "x", 2, "timeout"), ("a", "y", 3, "unstable")))
    assert sorted(tuple(r) for r in done.collect()) == [("a", "hash", "error", 1), ("a", "metadata", "unstable", 1)]
    assert rows(spark, path, "entries", "root_label", "rel_path", "meta_status", "hash_status") == [("a", "x", "done", "error"), ("a", "y", "unstable", "done"), ("b b/=", "x", "done", "done"), ("c", "z", "done", "done")]
    assert rows(spark, path, "read_performance", "attempt_id", "bytes_read", "elapsed_seconds", "session_id", "stage") == [(2, 7, 1.5, "s", "hash")]
    assert rows(spark, path, "entry_attempts", "attempt_id", "status") == [(1, "succeeded"), (2, "timeout"), (3, "unstable"), (4, "running"), (5, "succeeded")]
    assert {k: v for k, v in before.items() if "root_label=a" not in k}.items() <= files_of(path, "entries").items()
    assert working.recover(spark, path) == {"entry_attempts": 1, "entries": 0} and (4, "abandoned") in rows(spark, path, "entry_attempts", "attempt_id", "status")


def test_a_step_that_is_cut_off_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "w")
    made(spark, path, entry_attempts=table(spark, "entry_attempts", [{"root_label": "a", "rel_path": "x", "attempt_id": 1, "stage": "hash", "attempt_number": 1, "status": "running"}]), read_performance=table(spark, "read_performance", []))
    end = spark.createDataFrame([("a", "x", 1, "unstable", "t9", (3,))], "root_label string, rel_path string, attempt_id long, status string, ended_at_utc string, performance struct<bytes_read:bigint>")
    real = working.put
    with monkeypatch.context() as m:
        m.setattr(working, "put", lambda df, path, name, roots: real(df, path, name, roots) if name != "entry_attempts" else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            working.finish_attempts(spark, path, end)
    working.finish_attempts(spark, path, end)
    assert rows(spark, path, "entries", "root_label", "rel_path", "hash_status")[0] == ("a", "x", "unstable") and rows(spark, path, "read_performance", "attempt_id") == [(1,)]
    assert working.read(spark, path, ["entry_attempts"])["entry_attempts"].where(F.col("status") == "running").isEmpty()
