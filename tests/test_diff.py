"""Outcomes of comparisons on small snapshots."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as fn
from cairn.operators import diff, ranking

ENTRY = "root_label string, rel_path string, size long, mtime long, attrs long, hash_hex string, event string, unstable boolean, volume string, file_id string, payloads map<string,struct<sha:string,version:string,stable:string>>"


def side(spark, files, dirs=(), roots=("r",), failed=()):
    """files: dicts of rel_path and what differs from the usual."""
    usual = {"root_label": roots[0], "size": 1, "mtime": 0, "attrs": 0, "hash_hex": "h", "event": None, "unstable": False, "volume": None, "file_id": None, "payloads": {}}
    names = [c.split(" ")[0] for c in ENTRY.split(", ") if " " in c]
    rows = [tuple((usual | {"event": f["rel_path"]} | f)[n] for n in names[:11]) for f in files]
    entries = spark.createDataFrame(rows, ENTRY).withColumn("path_key", fn.path_key(F.col("rel_path")))
    folders = [(roots[0], "", "failed" if "" in failed else "ok")] + [(roots[0], d, "access_denied" if d in failed else "ok") for d in dirs]
    made = spark.createDataFrame(folders, "root_label string, rel_path string, enum_status string").withColumn("path_key", fn.path_key(F.col("rel_path")))
    return {"roots": spark.createDataFrame([(r, "failed" if "" in failed else "ok") for r in roots], "root_label string, enum_status string"), "dirs": made, "entries": entries}


def rows(spark, old, new, **more):
    found = diff.compare(side(spark, old, **more.get("old", {})), side(spark, new, **more.get("new", {})))
    return sorted(((r.status, r.evidence, r.reason, r.old_path, r.new_path) for r in found["entries"].collect()), key=str)


F1 = {"rel_path": "a"}


CASES = [
    ([F1 | {"event": "o"}], [F1 | {"event": "n"}], [("unchanged", "independent_computation", None, "a", "a")]),
    ([F1], [F1], [("unchanged", "propagated_single_computation", None, "a", "a")]),
    ([F1], [F1 | {"size": 2}], [("content_changed", "stat_only", None, "a", "a")]),
    ([F1 | {"event": "o"}], [F1 | {"hash_hex": "x"}], [("content_changed", "independent_computation", None, "a", "a")]),
    ([F1], [F1 | {"mtime": 5}], [("stat_changed_content_same", "propagated_single_computation", None, "a", "a")]),
    ([F1 | {"hash_hex": None}], [F1 | {"hash_hex": None}], [("hash_missing", "insufficient", None, "a", "a")]),
    ([F1], [F1 | {"unstable": True}], [("unstable", "insufficient", "unstable", "a", "a")]),
    ([{"rel_path": "d1/f", "event": "e"}], [{"rel_path": "d2/g", "event": "x"}], [("moved_or_renamed", "independent_computation", "group_paired", "d1/f", "d2/g")]),
    ([F1, {"rel_path": "b"}], [F1, {"rel_path": "b"}, {"rel_path": "c", "event": "a"}], [("copied", "propagated_single_computation", None, None, "c"), ("unchanged", "propagated_single_computation", None, "a", "a"), ("unchanged", "propagated_single_computation", None, "b", "b")]),
    ([F1], [{"rel_path": "b", "hash_hex": "n"}], [("added", "insufficient", None, None, "b"), ("deleted", "insufficient", None, "a", None)]),
    ([F1], [F1, {"rel_path": "l", "volume": "v", "file_id": "1"}, {"rel_path": "m", "volume": "v", "file_id": "1"}], [("added", "insufficient", "hardlink_same_file_id", None, "l"), ("added", "insufficient", "hardlink_same_file_id", None, "m"), ("unchanged", "propagated_single_computation", None, "a", "a")]),
    ([{"rel_path": "Foto.JPG", "event": "e"}], [{"rel_path": "foto.jpg", "event": "e"}], [("unchanged", "propagated_single_computation", "case_or_form_rename", "Foto.JPG", "foto.jpg")]),
    ([{"rel_path": unicodedata.normalize("NFD", "é"), "event": "e"}], [{"rel_path": unicodedata.normalize("NFC", "é"), "event": "e"}], [("unchanged", "propagated_single_computation", "case_or_form_rename", unicodedata.normalize("NFD", "é"), "é")]),
    ([F1 | {"hash_hex": None, "volume": "v", "file_id": "1"}], [{"rel_path": "b", "volume": "v", "file_id": "1"}], [("moved_or_renamed", "heuristic_file_id", "file_id_heuristic", "a", "b")]),
    ([], [{"rel_path": "b", "hash_hex": None, "unstable": True}], [("added", "insufficient", "unstable_content", None, "b")]),
    ([{"rel_path": "A"}, {"rel_path": "a"}], [{"rel_path": "A"}, {"rel_path": "a"}], [("unknown", "insufficient", "path_key_collision", *x) for x in (("A", None), ("a", None), (None, "A"), (None, "a"))]),
]


def test_outcomes(spark):
    """Every case is a root of its own, with contents and file ids of its own."""

    def of(which):
        rows = []
        for i, case in enumerate(CASES):
            for f in case[which]:
                f = {"hash_hex": "h", "event": f["rel_path"]} | f | {"root_label": f"s{i}"}
                rows.append(f | {"hash_hex": f["hash_hex"] and f"{i} {f['hash_hex']}", "volume": f.get("volume") and f"{i} {f['volume']}"})
        made = side(spark, rows)
        labels = [f"s{i}" for i in range(len(CASES))]
        made["roots"] = spark.createDataFrame([(x, "ok") for x in labels], "root_label string, enum_status string")
        made["dirs"] = spark.createDataFrame([(x, "", "", "ok") for x in labels], "root_label string, rel_path string, path_key string, enum_status string")
        return made

    found = diff.compare(of(0), of(1))["entries"].collect()
    for i, (_, _, expected) in enumerate(CASES):
        got = [(r.status, r.evidence, r.reason, r.old_path, r.new_path) for r in found if f"s{i}" in (r.old_root, r.new_root)]
        assert sorted(got, key=str) == sorted(expected, key=str), i


def test_gap(spark):
    old = [{"rel_path": "d/x"}, {"rel_path": "d/y"}, {"rel_path": "dx"}]
    args = {"dirs": ["d"]}
    found = diff.compare(side(spark, old, **args), side(spark, [{"rel_path": "dx"}], failed=["d"], **args))
    assert sorted((r.status, r.reason) for r in found["entries"].collect()) == [("unchanged", None), ("unknown", "enum_failed_new"), ("unknown", "enum_failed_new")]
    assert [(r.rel_path, r.affected_estimate) for r in found["subtrees"].collect()] == [("d", 2)]
    assert {(r.path_key, r.status) for r in found["dirs"].collect()} == {("", "unchanged"), ("d", "enum_status_changed")}


def test_metadata(spark):
    tags = lambda sha, stable: {"payloads": {"exiftool": (sha, "1", stable)}}
    found = diff.compare(side(spark, [F1 | tags("s", "t"), {"rel_path": "b"} | tags("s", "t")]), side(spark, [F1 | tags("x", "t"), {"rel_path": "b"} | tags("x", "y")]))["entries"]
    assert sorted((r.new_path, r.status, r.metadata_changed) for r in found.collect()) == [("a", "unchanged", 0), ("b", "metadata_extraction_changed", 1)]


def test_swap_of_sides(spark):
    old, new = [F1, {"rel_path": "b", "hash_hex": "x"}], [F1, {"rel_path": "c", "hash_hex": "y"}]
    swap = {"added": "deleted", "deleted": "added"}
    there, back = rows(spark, old, new), rows(spark, new, old)
    assert sorted((swap.get(r[0], r[0]), str(r[4]), str(r[3])) for r in there) == sorted((r[0], str(r[3]), str(r[4])) for r in back)


def test_roots(spark):
    one = diff.compare(side(spark, [F1], roots=("x",)), side(spark, [F1], roots=("y",)))["entries"].collect()
    assert [(r.status, r.old_root, r.new_root) for r in one] == [("unchanged", "x", "y")]
    two = diff.compare(side(spark, [F1], roots=("x", "z")), side(spark, [F1 | {"hash_hex": "q"}], roots=("y",)))["entries"].collect()
    assert sorted((r.status, r.reason) for r in two) == [("added", "unpaired_root"), ("deleted", "unpaired_root")]


def test_conclusion_and_empty(spark):
    same = diff.compare(side(spark, [F1]), side(spark, [F1]))
    row = diff.conclusion(same["entries"], same["dirs"]).first()
    assert (row.content, row.structure) == ("same", "same")
    assert diff.compare(side(spark, []), side(spark, []))["entries"].count() == 0


def by_hand(lost, fresh):
    """Fresh rows in order take the first lost row that is left, unless both have hashes."""
    left, out = sorted(lost), []
    for path, hashed in sorted(fresh):
        at = next((k for k, x in enumerate(left) if not (hashed and x[1])), None)
        if at is not None:
            out.append((left.pop(at)[0], path))
    return out


def test_file_ids_in_order(spark):
    rng = random.Random(3)
    lost, fresh, want = [], [], []
    for key in range(40):
        a = [(f"{key}/{rng.random()}", rng.random() < 0.5) for _ in range(rng.randint(1, 5))]
        b = [(f"{key}/{rng.random()}", rng.random() < 0.5) for _ in range(rng.randint(1, 5))]
        want += by_hand(a, b)
        for rows, out in ((a, lost), (b, fresh)):
            out += [("r", path, path, 1, "0", f"h{path}" if hashed else None, "v", str(key), "computed", None) for path, hashed in rows]
    schema = "root_label string, rel_path string, path_key string, size long, mtime string, hash_hex string, volume string, file_id string, origin string, reason string"
    make = lambda rows: spark.createDataFrame(rows, schema)
    found = diff.match_file_ids(make(lost), make(fresh)).select("old.rel_path", F.col("new.rel_path").alias("to")).collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert diff.match_file_ids(make(lost[:1]), make([])).count() == 0


FILE_ROW = "root_label string, rel_path string, path_key string, size long, mtime string, hash_hex string, volume string, file_id string, origin string, reason string"


def test_file_ids_of_any_number(spark, monkeypatch):
    """Keys within and across runs of places, with every share of hashed rows on either side: each as the matcher by hand has it."""
    monkeypatch.setattr(ranking, "GROUP_ROWS", 7)
    rng = random.Random(11)
    lost, fresh, want = [], [], []
    for key in range(60):
        sides = []
        for _ in range(2):
            n, share = rng.choice([0, 1, 3, 6, 7, 8, 15, 40]), rng.choice([0, 0.1, 0.5, 0.9, 1])
            sides.append([(f"{key}/{rng.random()}", rng.random() < share) for _ in range(n)])
        want += by_hand(*sides)
        for rows, out in zip(sides, (lost, fresh), strict=True):
            out += [("r", path, path, 1, "0", f"h{path}" if hashed else None, "v", str(key), "computed", None) for path, hashed in rows]
    made = [spark.createDataFrame(x, FILE_ROW) for x in (lost, fresh)]
    assert sorted(map(tuple, diff.match_file_ids(*made).select("old.rel_path", F.col("new.rel_path").alias("to")).collect())) == sorted(want)


def test_file_ids_below_and_above_a_run(spark, monkeypatch):
    row = lambda path, hashed: ("r", path, path, 1, "0", path if hashed else None, "v", "1", "computed", None)
    lost, fresh = spark.createDataFrame([row("a", False), row("b", True)], FILE_ROW), spark.createDataFrame([row("c", False)], FILE_ROW)
    for most in (200_000, 1):
        monkeypatch.setattr(ranking, "GROUP_ROWS", most)
        assert diff.match_file_ids(lost, fresh).select("old.rel_path", F.col("new.rel_path").alias("to")).collect() == [("a", "c")]


def test_content_of_many_runs(spark, monkeypatch):
    """One content in more rows than a run: pairs by rank, the rest copied or added, as without runs."""
    old = [{"rel_path": f"o{i:02}", "hash_hex": "h"} for i in range(9)]
    new = [{"rel_path": f"n{i:02}", "hash_hex": "h", "event": None} for i in range(30)] + [{"rel_path": f"m{i}", "hash_hex": "g"} for i in range(12)]
    plain = rows(spark, old, new)
    monkeypatch.setattr(ranking, "GROUP_ROWS", 4)
    assert rows(spark, old, new) == plain and [r[0] for r in plain].count("copied") == 21


def test_stored_sides_are_held_to_one_rule(spark):
    info = lambda status, rule: spark.createDataFrame([(status, rule)], "status string, path_key_rule int")
    diff.admit_snapshots(info("complete", 1), info("complete", 1))
    for a, b in ((info("complete", 1), info("complete", 2)), (info("running", 1), info("complete", 1))):
        with pytest.raises(ValueError):
            diff.admit_snapshots(a, b)


def test_sides_are_read_once(spark):
    """What makes a side's entries is done once a comparison, however many steps read them."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(h):
        made.add(1)
        return h

    old, new = side(spark, [{"rel_path": f"a{k}", "hash_hex": f"h{k % 7}"} for k in range(40)]), side(spark, [{"rel_path": f"b{k}", "hash_hex": f"h{k % 9}"} for k in range(40)])
    found = diff.compare(*({**s, "entries": s["entries"].withColumn("hash_hex", costly("hash_hex"))} for s in (old, new)))
    assert found["entries"].count() >= 40 and found["groups"].count() == 9
    assert made.value == 80
