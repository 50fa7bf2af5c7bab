"""Queries of the snapshot comparison over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import diff

from . import model


def compared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return diff.compare(model.snapshot(spark, sf_dir, False), model.snapshot(spark, sf_dir, True))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)["entries"].select(*diff.RESULT)


QUERIES = {
    "diff_entries": entries,
    "diff_status_evidence": lambda s, d: diff.status_evidence(entries(s, d)),
    "diff_metadata_evidence": lambda s, d: diff.metadata_evidence(entries(s, d)),
    "diff_content_groups": lambda s, d: compared(s, d)["groups"],
    "diff_changed_groups": lambda s, d: diff.changed_groups(compared(s, d)["groups"]),
    "diff_dirs": lambda s, d: compared(s, d)["dirs"],
    "diff_gap_subtrees": lambda s, d: compared(s, d)["subtrees"],
    "diff_conclusion": lambda s, d: (lambda c: diff.conclusion(c["entries"], c["dirs"]))(compared(s, d)),
    "diff_issue_rows": lambda s, d: diff.issue_rows(entries(s, d)),
    "diff_reason_bytes": lambda s, d: entries(s, d).groupBy("status", "reason").agg(F.count("*").alias("n"), F.sum("old_size").alias("old_bytes"), F.sum("new_size").alias("new_bytes")),
}

_groups = f"""{model.ENTRIES},
g AS (SELECT hash_hex, (SELECT count(*) FROM o WHERE o.hash = hash_hex) AS old_count, (SELECT count(*) FROM n WHERE n.hash = hash_hex) AS new_count, CAST(0 AS BIGINT) AS old_hardlink_sets, CAST(0 AS BIGINT) AS new_hardlink_sets
  FROM (SELECT DISTINCT hash AS hash_hex FROM pend WHERE hash IS NOT NULL)),
gc AS (SELECT *, CAST(old_count AS VARCHAR) || '->' || CAST(new_count AS VARCHAR) AS classification FROM g)"""
_n = lambda column, *words: f"count(*) FILTER ({column} IN ({', '.join(repr(w) for w in words)}))"

ORACLE_SQL = {
    "diff_entries": f"WITH {model.ENTRIES.strip()} SELECT * FROM e",
    "diff_status_evidence": f"WITH {model.ENTRIES.strip()} SELECT status, evidence, count(*) AS n FROM e GROUP BY ALL",
    "diff_metadata_evidence": f"""WITH {model.ENTRIES.strip()} SELECT CASE WHEN metadata_changed = 1 THEN 'changed' WHEN metadata_changed = 0 THEN 'unchanged'
        WHEN old_path IS NOT NULL AND new_path IS NOT NULL THEN 'unavailable' ELSE 'not_applicable' END AS kind, count(*) AS n FROM e GROUP BY ALL""",
    "diff_content_groups": f"WITH {_groups.strip()} SELECT * FROM gc",
    "diff_changed_groups": f"WITH {_groups.strip()} SELECT * FROM gc WHERE old_count <> new_count",
    "diff_dirs": f"WITH {model.SIDES.strip()}, {model.DIRS.strip()} SELECT * FROM ds",
    "diff_gap_subtrees": f"""WITH {model.SIDES.strip()} SELECT 'new' AS side, '{model.FAILED_ROOT}' AS root_label, '{model.FAILED_DIR}' AS rel_path, 'access_denied' AS enum_status,
        count(*) FILTER (root = '{model.FAILED_ROOT}' AND (path = '{model.FAILED_DIR}' OR starts_with(path, '{model.FAILED_DIR}/'))) AS affected_estimate FROM o
        WHERE EXISTS (SELECT 1 FROM nd WHERE root = '{model.FAILED_ROOT}' AND path = '{model.FAILED_DIR}') HAVING count(*) > 0""",
    "diff_conclusion": f"""WITH {model.ENTRIES.strip()}, {model.DIRS.strip()},
        c AS (SELECT {_n("status", "content_changed", "added", "deleted", "copied")} AS content_breaking, {_n("status", "unknown", "hash_missing", "unstable")} AS content_caveats,
          {_n("status", "added", "deleted", "moved_or_renamed", "copied")} AS f, {_n("status", "unknown")} AS structure_caveats FROM e),
        x AS (SELECT content_breaking, content_caveats, structure_caveats, f + (SELECT {_n("status", "added", "deleted")} FROM ds) AS structure_breaking FROM c)
        SELECT *, CASE WHEN content_breaking > 0 THEN 'changed' WHEN content_caveats > 0 THEN 'undecided' ELSE 'same' END AS content,
          CASE WHEN structure_breaking > 0 THEN 'changed' WHEN structure_caveats > 0 THEN 'undecided' ELSE 'same' END AS structure FROM x""",
    "diff_issue_rows": f"WITH {model.ENTRIES.strip()} SELECT *, count(*) OVER () AS total FROM e WHERE status IN ('unstable', 'unknown') ORDER BY status, path_key, old_path NULLS FIRST, new_path NULLS FIRST LIMIT 500",
    "diff_reason_bytes": f"WITH {model.ENTRIES.strip()} SELECT status, reason, count(*) AS n, CAST(sum(old_size) AS BIGINT) AS old_bytes, CAST(sum(new_size) AS BIGINT) AS new_bytes FROM e GROUP BY ALL",
}
