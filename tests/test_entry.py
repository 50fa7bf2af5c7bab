"""The driver's contract: names, columns, and equality with SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from cairn.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(str([show(r[k]) for k in order]) for r in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["diff_entries", "files", "snapshot_counts", "metadata_issues", "read_outliers", "stratified_sample", "circuit_breaker", "payload_tags", "path_functions", "layout_gaps", "path_keys", "time_functions", "diff_published", "file_changes", "run_records", "issue_report", "disk_summary", "tree_digests", "reconciled_bundle", "finished_attempts", "deep_rows", "export_archives", "slow_reads", "execution_counts"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    found = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), columns)
