"""The driver's tables seen as snapshots of an archive, in Spark and in SQL.

``documents`` gives two snapshots of one archive: roots are sources, folders
are languages, files are documents, and the newer side is changed by fixed
rules, so that every outcome of a comparison occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as fn
from cairn.sources.storage import stored

#: The folder that the newer snapshot couldn't list.
FAILED_ROOT, FAILED_DIR = "src7", "de"
#: Documents by remainder: (divisor, remainder) of each change.
RULES = {"absent_old": (13, 0), "absent_new": (17, 0), "moved": (11, 5), "longer": (19, 3), "edited": (31, 2), "touched": (23, 7), "unhashed": (29, 1), "unstable": (37, 5), "retagged": (41, 4), "reused": (2, 0)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule(name: str):
    divisor, remainder = RULES[name]
    return F.col("doc_id") % divisor == remainder


def snapshot(spark: SparkSession, sf_dir: str, newer: bool, keep: bool = False) -> dict[str, DataFrame]:
    """One of the two snapshots; with ``keep`` its entries are written once, for jobs that make many tables of them."""
    docs = table(spark, sf_dir, "documents").where(~rule("absent_new" if newer else "absent_old"))
    text = F.coalesce(F.col("text"), F.lit(""))
    path = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    version, sha = F.lit("1"), F.sha2(F.concat(F.lit("tags "), F.col("doc_id").cast("string")), 256)
    event, mtime = F.concat(F.lit("old "), F.col("doc_id").cast("string")), F.lit(0).cast("long")
    hashed = F.lit(True)
    if newer:
        path = F.when(rule("moved"), F.concat(F.lit("moved/"), path)).otherwise(path)
        text = F.when(rule("longer"), F.concat(text, F.lit("!"))).when(rule("edited"), F.concat(F.lit("X"), F.substr(text, F.lit(2)))).otherwise(text)
        mtime = F.when(rule("touched"), 1).otherwise(0).cast("long")
        hashed = ~rule("unhashed")
        sha = F.when(rule("retagged"), F.sha2(F.lit("other tags"), 256)).otherwise(sha)
        event = F.when(rule("reused"), event).otherwise(F.concat(F.lit("new "), F.col("doc_id").cast("string")))
    digest = F.sha2(text.cast("binary"), 256)
    stable = sha
    entries = docs.select(
        F.col("source").alias("root_label"), path.alias("rel_path"), fn.path_key(path, ascii_only=True).alias("path_key"), F.octet_length(text).cast("long").alias("size"), mtime.alias("mtime"), F.lit(32).cast("long").alias("attrs"),
        F.when(hashed, digest).alias("hash_hex"), F.when(hashed, event).alias("event"), (rule("unstable") & F.lit(newer)).alias("unstable"),
        F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("volume"), fn.id_hex(F.col("doc_id") + 1).alias("file_id"),
        F.when(hashed, F.when(rule("reused") & F.lit(newer), "reused").otherwise("computed")).alias("origin"),
        F.when(F.col("doc_id") % 5 == 0, F.create_map(F.lit("exiftool"), F.struct(sha.alias("sha"), version.alias("version"), stable.alias("stable")))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<sha:string,version:string,stable:string>>"))).alias("payloads"),
    )
    if keep:
        entries = stored(entries, "listed")
    folder = fn.parent_path(F.col("rel_path"))
    failed = (F.col("root_label") == FAILED_ROOT) & (F.col("path_key") == FAILED_DIR) & F.lit(newer)
    dirs = entries.select("root_label", F.explode(fn.ancestors(folder)).alias("rel_path")).distinct().withColumn("path_key", F.col("rel_path")).withColumn("enum_status", F.when(failed, "access_denied").otherwise("ok"))
    roots = entries.select("root_label").distinct().withColumn("enum_status", F.lit("ok"))
    return {"roots": roots, "dirs": dirs, "entries": entries}


def _when(name: str) -> str:
    divisor, remainder = RULES[name]
    return f"doc_id % {divisor} = {remainder}"


#: The same two snapshots in SQL: CTEs o and n (entries) and od and nd (directories).
SIDES = f"""
base AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, 'v' || CAST(doc_id % 3 AS VARCHAR) AS volume, doc_id + 1 AS file_id,
  CASE WHEN doc_id % 5 = 0 THEN sha256('tags ' || CAST(doc_id AS VARCHAR)) END AS tags FROM documents),
o AS (SELECT doc_id, source AS root, path, strlen(text) AS size, 0 AS mtime, sha256(text) AS hash, 'old ' || CAST(doc_id AS VARCHAR) AS event, false AS unstable, volume, file_id, tags FROM base WHERE NOT ({_when("absent_old")})),
changed AS (SELECT *, CASE WHEN {_when("longer")} THEN text || '!' WHEN {_when("edited")} THEN 'X' || substr(text, 2) ELSE text END AS body FROM base WHERE NOT ({_when("absent_new")})),
n AS (SELECT doc_id, source AS root, CASE WHEN {_when("moved")} THEN 'moved/' || path ELSE path END AS path, strlen(body) AS size, CASE WHEN {_when("touched")} THEN 1 ELSE 0 END AS mtime,
  CASE WHEN NOT ({_when("unhashed")}) THEN sha256(body) END AS hash,
  CASE WHEN NOT ({_when("unhashed")}) THEN CASE WHEN {_when("reused")} THEN 'old ' ELSE 'new ' END || CAST(doc_id AS VARCHAR) END AS event,
  {_when("unstable")} AS unstable, volume, file_id, CASE WHEN tags IS NOT NULL AND {_when("retagged")} THEN sha256('other tags') ELSE tags END AS tags FROM changed),
od AS (SELECT DISTINCT root, unnest(['', split_part(path, '/', 1)]) AS path FROM o),
nd AS (SELECT DISTINCT root, unnest(CASE WHEN path LIKE 'moved/%' THEN ['', 'moved', 'moved/' || split_part(path, '/', 2)] ELSE ['', split_part(path, '/', 1)] END) AS path FROM n)"""

#: All result rows of the comparison of entries, as CTE e.
ENTRIES = f"""{SIDES},
roots AS (SELECT DISTINCT o.root FROM o JOIN n USING (root)),
j AS (SELECT coalesce(o.root, n.root) AS root, coalesce(o.path, n.path) AS path, o.doc_id AS oi, n.doc_id AS ni, o.size AS os, n.size AS ns, o.mtime AS om, n.mtime AS nm, o.hash AS oh, n.hash AS nh, o.event AS oe, n.event AS ne,
  n.unstable AS nu, o.tags AS ot, n.tags AS nt FROM o FULL JOIN n ON o.root = n.root AND o.path = n.path),
k AS (SELECT *, root = '{FAILED_ROOT}' AND (path = '{FAILED_DIR}' OR starts_with(path, '{FAILED_DIR}/')) AS blind, root NOT IN (SELECT root FROM roots) AS alone FROM j),
same AS (SELECT root, path, os, ns, oh, nh,
  CASE WHEN nu THEN 'unstable' WHEN os <> ns THEN 'content_changed' WHEN nh IS NULL THEN 'hash_missing' WHEN oh <> nh THEN 'content_changed' WHEN om <> nm THEN 'stat_changed_content_same' WHEN ot <> nt THEN 'metadata_extraction_changed' ELSE 'unchanged' END AS status,
  CASE WHEN nu THEN 'insufficient' WHEN os <> ns THEN 'stat_only' WHEN nh IS NULL THEN 'insufficient' WHEN oe = ne THEN 'propagated_single_computation' ELSE 'independent_computation' END AS evidence,
  CASE WHEN nu THEN 'unstable' END AS reason, CASE WHEN ot IS NOT NULL AND nt IS NOT NULL THEN CAST(ot <> nt AS INTEGER) END AS meta FROM k WHERE oi IS NOT NULL AND ni IS NOT NULL AND NOT blind AND NOT alone),
pend AS (SELECT o.*, 'old' AS side, alone FROM o JOIN k ON oi = o.doc_id AND ((ni IS NULL AND NOT blind) OR alone) UNION ALL SELECT n.*, 'new', alone FROM n JOIN k ON ni = n.doc_id AND ((oi IS NULL AND NOT blind) OR alone)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY side, hash ORDER BY path, root) AS rk, CASE WHEN unstable THEN 'unstable_content' WHEN alone THEN 'unpaired_root' END AS why FROM pend WHERE hash IS NOT NULL),
pairs AS (SELECT a, b FROM (SELECT r AS a, r.hash AS h, r.rk AS k FROM ranks r WHERE side = 'old') FULL JOIN (SELECT r AS b, r.hash AS h, r.rk AS k FROM ranks r WHERE side = 'new') USING (h, k)),
moved AS (SELECT a, b FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL),
links AS (SELECT hash, volume, file_id FROM n WHERE hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
late AS (SELECT b, links.hash IS NOT NULL AS linked, b.hash IN (SELECT hash FROM o) AS known, EXISTS (SELECT 1 FROM o WHERE o.hash = b.hash AND o.event = b.event) AS event_known
  FROM pairs LEFT JOIN links ON links.hash = b.hash AND links.volume = b.volume AND links.file_id = b.file_id WHERE a IS NULL),
lost AS (SELECT a.root AS root, a.path AS path, a.size AS size, a.mtime AS mtime, a.hash AS hash, a.volume AS volume, a.file_id AS file_id, a.why AS why FROM pairs WHERE b IS NULL),
fresh AS (SELECT b.root AS root, b.path AS path, b.size AS size, b.mtime AS mtime, b.hash AS hash, b.volume AS volume, b.file_id AS file_id, CASE WHEN linked THEN 'hardlink_same_file_id' ELSE b.why END AS why FROM late WHERE linked OR NOT known
  UNION ALL SELECT root, path, size, mtime, hash, volume, file_id, CASE WHEN unstable THEN 'unstable_content' WHEN alone THEN 'unpaired_root' END FROM pend WHERE hash IS NULL AND side = 'new'),
ids AS (SELECT l.root AS lr, l.path AS lp, l.size AS ls, l.hash AS lh, f.root AS fr, f.path AS fp, f.size AS fs, f.hash AS fh FROM lost l JOIN fresh f USING (volume, file_id, size, mtime) WHERE l.hash IS NULL OR f.hash IS NULL),
e AS (
SELECT path AS path_key, CASE WHEN oi IS NOT NULL THEN root END AS old_root, CASE WHEN ni IS NOT NULL THEN root END AS new_root, CASE WHEN oi IS NOT NULL THEN path END AS old_path, CASE WHEN ni IS NOT NULL THEN path END AS new_path,
  os AS old_size, ns AS new_size, oh AS old_hash, nh AS new_hash, 'unknown' AS status, 'insufficient' AS evidence, 'enum_failed_new' AS reason, CAST(NULL AS INTEGER) AS metadata_changed FROM k WHERE blind AND NOT alone
UNION ALL SELECT path, root, root, path, path, os, ns, oh, nh, status, evidence, reason, meta FROM same
UNION ALL SELECT b.path, a.root, b.root, a.path, b.path, a.size, b.size, a.hash, b.hash, 'moved_or_renamed', CASE WHEN a.event = b.event THEN 'propagated_single_computation' ELSE 'independent_computation' END, 'group_paired', NULL FROM moved
UNION ALL SELECT b.path, NULL, b.root, NULL, b.path, NULL, b.size, NULL, b.hash, 'copied', CASE WHEN event_known THEN 'propagated_single_computation' ELSE 'independent_computation' END, NULL, NULL FROM late WHERE known AND NOT linked
UNION ALL SELECT fp, lr, fr, lp, fp, ls, fs, lh, fh, 'moved_or_renamed', 'heuristic_file_id', 'file_id_heuristic', NULL FROM ids
UNION ALL SELECT path, root, NULL, path, NULL, size, NULL, hash, NULL, 'deleted', 'insufficient', why, NULL FROM lost WHERE (root, path) NOT IN (SELECT (lr, lp) FROM ids)
UNION ALL SELECT path, NULL, root, NULL, path, NULL, size, NULL, hash, 'added', 'insufficient', why, NULL FROM fresh WHERE (root, path) NOT IN (SELECT (fr, fp) FROM ids))"""

#: Directories of the comparison, as CTE d; needs SIDES.
DIRS = f"""
d AS (SELECT coalesce(od.path, nd.path) AS path_key, od.root AS old_root, nd.root AS new_root, od.path AS old_path, nd.path AS new_path, CASE WHEN od.root IS NOT NULL THEN 'ok' END AS old_enum,
  CASE WHEN nd.root IS NOT NULL THEN CASE WHEN nd.root = '{FAILED_ROOT}' AND nd.path = '{FAILED_DIR}' THEN 'access_denied' ELSE 'ok' END END AS new_enum FROM od FULL JOIN nd ON od.root = nd.root AND od.path = nd.path),
ds AS (SELECT *, CASE WHEN old_root IS NOT NULL AND new_root IS NOT NULL THEN CASE WHEN old_enum <> new_enum THEN 'enum_status_changed' ELSE 'unchanged' END
  WHEN old_root IS NOT NULL THEN CASE WHEN old_root = '{FAILED_ROOT}' AND (path_key = '{FAILED_DIR}' OR starts_with(path_key, '{FAILED_DIR}/')) THEN 'unknown' ELSE 'deleted' END ELSE 'added' END AS status,
  CASE WHEN old_root IS NOT NULL AND new_root IS NULL THEN CASE WHEN old_root = '{FAILED_ROOT}' AND (path_key = '{FAILED_DIR}' OR starts_with(path_key, '{FAILED_DIR}/')) THEN 'enum_failed_new' END END AS reason FROM d)"""
