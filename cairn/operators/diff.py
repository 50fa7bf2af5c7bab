"""Comparison of two snapshots.

A side is a dict of DataFrames. ``roots``: root_label, enum_status. ``dirs``:
root_label, rel_path, path_key, enum_status. ``entries``: root_label, rel_path,
path_key, size, mtime, attrs, hash_hex (of a valid hash, else null), event (the
computation that the hash goes back to), unstable, volume, file_id, origin (of
the hash; may be left out), and payloads (map from provider to struct of sha,
version and stable, the digest without volatile tags). ``comparison_sides`` makes
both sides from stored snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.payload import payload_digest
from cairn.functions.text import ancestors
from cairn.sources.files import inflate
from cairn.sources.storage import stored

from . import ranking
from .ranking import ranked, running

Side = dict[str, DataFrame]
TAG_PROVIDER = "exiftool"  # fixed value: the provider whose payloads hold volatile tags
SIDE_COLUMNS = ["rel_path", "size", "mtime", "attrs", "hash_hex", "event", "unstable", "volume", "file_id", "origin", "payloads"]
RESULT = ["path_key", "old_root", "new_root", "old_path", "new_path", "old_size", "new_size", "old_hash", "new_hash", "status", "evidence", "reason", "metadata_changed"]
#: What exports of a result have besides.
MORE = ["old_mtime", "new_mtime", "old_origin", "new_origin", "group_hash"]


def admit(old: Side, new: Side) -> None:
    """Refuse a side with a failed root that has no failed directory row at its top."""
    for name, side in (("old", old), ("new", new)):
        failed = side["roots"].where("enum_status = 'failed'").select("root_label")
        tops = side["dirs"].where("path_key = '' and enum_status <> 'ok'").select("root_label")
        if not failed.join(tops, "root_label", "left_anti").isEmpty():
            raise ValueError(f"{name}: a failed root has no failed directory row")


def admit_snapshots(old: DataFrame, new: DataFrame) -> None:
    """Refuse two snapshots (their snapshot_info, one row each) of which one isn't sealed or whose path keys follow other rules."""
    a, b = old.first(), new.first()
    for name, info in (("old", a), ("new", b)):
        if info is None or info.status != "complete":
            raise ValueError(f"{name} isn't sealed")
    if a.path_key_rule != b.path_key_rule:
        raise ValueError("path keys follow other rules")


def comparison_sides(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[Side, Side]:
    """Both sides of a comparison from two stored snapshots (their tables: snapshot_info, roots, dirs, entries, hashes, raw_payloads).

    An entry's hash counts if it is valid; it goes back to the computation in its
    own snapshot or, where it was reused, in the one it came from. An entry is
    unstable if its metadata, its hash or the hash's record says so. Payloads are
    unpacked for their stable digests only where the other side doesn't have the
    same bytes.
    """
    admit_snapshots(old["snapshot_info"], new["snapshot_info"])
    return _side(old, new), _side(new, old)


def _side(tables: dict[str, DataFrame], other: dict[str, DataFrame]) -> Side:
    key = ["root_label", "rel_path"]
    own = tables["snapshot_info"].select(F.col("snapshot_uuid").alias("_uuid"))
    sha = tables["hashes"].where("algorithm = 'sha256'").join(F.broadcast(own), F.lit(True))  # one row
    event = F.when(F.col("origin") == "computed", F.concat_ws(" ", "_uuid", "finished_at_utc")).otherwise(F.concat_ws(" ", "source_snapshot_uuid", "source_computed_at_utc"))
    sha = sha.select(*key, F.struct("hash_hex", event.alias("event"), "origin", (F.col("status") == "valid").alias("valid"), (F.col("status") == "unstable").alias("unstable")).alias("_h"))
    payloads = tables["raw_payloads"].select(*key, "provider", "payload_zlib", F.col("payload_sha256").alias("sha"), F.col("provider_version").alias("version"))
    there = other["raw_payloads"].where(F.col("provider") == TAG_PROVIDER).select(F.col("payload_sha256").alias("sha")).distinct()
    fresh = payloads.where(F.col("provider") == TAG_PROVIDER).join(there, "sha", "left_anti")
    stable = fresh.select("sha", "payload_zlib").dropDuplicates(["sha"]).select("sha", payload_digest(inflate("payload_zlib")).alias("stable"))
    described = payloads.drop("payload_zlib").join(stable, "sha", "left").select(*key, F.struct("provider", F.struct("sha", "version", F.coalesce("stable", "sha").alias("stable")).alias("p")).alias("x"))
    listed = described.groupBy(*key).agg(F.map_from_entries(F.collect_list("x")).alias("payloads"))  # providers of one entry: a few
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<sha:string,version:string,stable:string>>"))
    rows = tables["entries"].join(sha, key, "left").join(listed, key, "left")
    valid = F.coalesce(F.col("_h.valid"), F.lit(False))
    unstable = F.coalesce(F.col("meta_status") == "unstable", F.lit(False)) | F.coalesce(F.col("hash_status") == "unstable", F.lit(False)) | F.coalesce(F.col("_h.unstable"), F.lit(False))
    entries = rows.select(
        *key, "path_key", F.col("size_bytes").alias("size"), F.col("modified_at_utc").alias("mtime"), F.col("attributes").alias("attrs"), F.when(valid, F.col("_h.hash_hex")).alias("hash_hex"), F.when(valid, F.col("_h.event")).alias("event"), unstable.alias("unstable"),
        F.col("volume_serial").alias("volume"), F.col("file_index_hex").alias("file_id"), F.when(valid, F.col("_h.origin")).alias("origin"), F.coalesce("payloads", none).alias("payloads"),
    )
    return {"roots": tables["roots"].select("root_label", "enum_status"), "dirs": tables["dirs"].select(*key, "path_key", "enum_status"), "entries": entries}


def pair_roots(old: Side, new: Side, mapping: DataFrame | None = None) -> DataFrame:
    """old_root and new_root of paired roots: by mapping (old_root, new_root), else by label, else the only root of either side."""
    left, right = (s["roots"].select(F.col("root_label").alias(n)) for s, n in ((old, "old_root"), (new, "new_root")))
    if mapping is not None:
        left = left.join(F.broadcast(mapping.withColumnRenamed("new_root", "mapped")), "old_root", "left")
    else:
        left = left.withColumn("mapped", F.lit(None).cast("string"))
    pairs = left.join(right, F.coalesce("mapped", "old_root") == F.col("new_root")).select("old_root", "new_root")
    alone = lambda df, n: df.agg(F.count("*").alias("n"), F.first(n).alias(n))
    single = alone(left, "old_root").withColumnRenamed("n", "n_old").join(alone(right, "new_root").withColumnRenamed("n", "n_new"), F.lit(True))
    single = single.where("n_old = 1 and n_new = 1").select("old_root", "new_root")
    return pairs.unionByName(single).distinct()


def flag_under_failed(df: DataFrame, dirs: DataFrame, root: str, flag: str) -> DataFrame:
    """Add ``flag``: true for rows (``root``, path_key) at or below a directory that couldn't be listed, else null.

    Most comparisons have no such directory, and no path is taken apart. Otherwise the paths
    of the roots that have some are, and meet the directories in an equi-join on their ancestors.
    """
    failed = dirs.where("enum_status <> 'ok'").select(F.col("root_label").alias(root), F.col("path_key").alias("above"))
    if failed.isEmpty():
        return df.withColumn(flag, F.lit(None).cast("boolean"))
    roots = F.broadcast(failed.select(root).distinct())  # roots: a few rows a side
    up = df.select(root, "path_key").join(roots, root, "left_semi").distinct().withColumn("above", F.explode(ancestors(F.col("path_key"))))
    found = up.join(failed, [root, "above"], "left_semi").select(root, "path_key").distinct().withColumn(flag, F.lit(True))
    return df.join(found, [root, "path_key"], "left")


def metadata_changed(old: Column, new: Column) -> Column:
    """Null without a common provider, else 1 or 0."""
    common = F.array_intersect(F.map_keys(old), F.map_keys(new))
    same = lambda p: old[p]["sha"].eqNullSafe(new[p]["sha"]) & old[p]["version"].eqNullSafe(new[p]["version"])
    soft = lambda p: (p == TAG_PROVIDER) & old[p]["version"].eqNullSafe(new[p]["version"])
    stable = F.coalesce(old[TAG_PROVIDER]["stable"] == new[TAG_PROVIDER]["stable"], F.lit(False))
    return (
        F.when(F.coalesce(F.size(common), F.lit(0)) < 1, F.lit(None).cast("int")).when(F.exists(common, lambda p: ~same(p) & ~soft(p)), 1)
        .when(F.exists(common, lambda p: ~same(p)), F.when(stable, 0).otherwise(1)).otherwise(0)
    )


def evidence_of(old_event: Column, new_event: Column) -> Column:
    return F.when(old_event.eqNullSafe(new_event), "propagated_single_computation").otherwise("independent_computation")


def hash_groups(old: Side, new: Side, candidates: DataFrame) -> DataFrame:
    """For every hash among ``candidates`` (hash_hex): counts and hard-link sets over the whole of both sides."""

    def counted(side: Side, name: str) -> DataFrame:
        rows = side["entries"].where("hash_hex is not null")
        links = rows.where("coalesce(volume, '') <> '' and coalesce(file_id, '') <> ''").groupBy("hash_hex", "volume", "file_id").count().where("count > 1").groupBy("hash_hex").agg(F.count("*").alias(f"{name}_hardlink_sets"))
        return rows.groupBy("hash_hex").agg(F.count("*").alias(f"{name}_count")).join(links, "hash_hex", "left")

    every = candidates.join(counted(old, "old"), "hash_hex", "left").join(counted(new, "new"), "hash_hex", "left").na.fill(0)
    return every.withColumn("classification", F.concat(F.col("old_count").cast("string"), F.lit("->"), F.col("new_count").cast("string")))


def result(df: DataFrame, **known: Column) -> DataFrame:
    """The columns of a result row; what isn't given is null, evidence is insufficient."""
    types = {"old_size": "long", "new_size": "long", "metadata_changed": "int"}
    known = {"evidence": F.lit("insufficient")} | known
    return df.select(*[known.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in RESULT + MORE])


def side_of(prefix: str, e: str = "") -> dict[str, Column]:
    col = lambda c: F.col(f"{e}{c}")
    return {f"{prefix}_root": col("root_label"), f"{prefix}_path": col("rel_path"), f"{prefix}_size": col("size"), f"{prefix}_hash": col("hash_hex"), f"{prefix}_mtime": col("mtime"), f"{prefix}_origin": col("origin")}


def with_origin(side: Side) -> Side:
    """A side whose entries say where their hashes come from; null where that isn't known."""
    entries = side["entries"]
    return side | {"entries": entries if "origin" in entries.columns else entries.withColumn("origin", F.lit(None).cast("string"))}


def compare(old: Side, new: Side, mapping: DataFrame | None = None) -> dict[str, DataFrame]:
    """``entries``, ``groups`` (content groups), ``dirs`` and ``subtrees`` of a comparison."""
    admit(old, new)
    # Entries may come from joins and digests of their own, and a dozen steps read them: they are written once a side.
    old, new = (side | {"entries": stored(with_origin(side)["entries"].select("root_label", "path_key", *SIDE_COLUMNS), "side")} for side in (old, new))
    pairs = pair_roots(old, new, mapping)
    label = F.broadcast(pairs)  # roots: a few rows a side
    lefts = old["entries"].join(label.withColumnRenamed("old_root", "root_label"), "root_label", "left").withColumnRenamed("new_root", "pair")
    rights = new["entries"].join(label.select(F.col("new_root").alias("root_label"), F.lit(True).alias("_paired")), "root_label", "left").withColumn("pair", F.when(F.col("_paired"), F.col("root_label"))).drop("_paired")
    unpaired = lambda df, side: df.where("pair is null").withColumn("side", F.lit(side)).withColumn("base_reason", F.lit("unpaired_root"))
    packed = lambda df, side: df.where("pair is not null").groupBy("pair", "path_key").agg(F.count("*").alias(f"{side}_n"), F.min(F.struct("root_label", *SIDE_COLUMNS[:-1])).alias(side), F.first("payloads").alias(f"{side}_payloads"))
    joined = packed(lefts, "old").join(packed(rights, "new"), ["pair", "path_key"], "full_outer")
    gone_dirs = old["dirs"].join(label.withColumnRenamed("old_root", "root_label"), "root_label").drop("root_label").withColumnRenamed("new_root", "root_label")
    for dirs, flag in ((gone_dirs, "under_old"), (new["dirs"], "under_new")):
        joined = flag_under_failed(joined, dirs, "pair", flag)
    collides = (F.coalesce("old_n", F.lit(0)) > 1) | (F.coalesce("new_n", F.lit(0)) > 1)
    # Several results branch off from here and from the rank pairs below: they are written once.
    joined = stored(joined.withColumn("collides", collides), "joined")
    blind = F.col("under_old").isNotNull() | F.col("under_new").isNotNull()

    # Every row of a key that stands twice on a side.
    keys = joined.where("collides").select("pair", "path_key")
    collided = [result(df.join(keys, ["pair", "path_key"], "left_semi"), path_key=F.col("path_key"), status=F.lit("unknown"), reason=F.lit("path_key_collision"), **side_of(side)) for df, side in ((lefts, "old"), (rights, "new"))]

    single = joined.where(~F.col("collides"))
    both = {**side_of("old", "old."), **side_of("new", "new.")}
    reason = F.concat_ws(",", F.when(F.col("under_old"), "enum_failed_old"), F.when(F.col("under_new"), "enum_failed_new"))
    unknown = result(single.where(blind), path_key=F.col("path_key"), status=F.lit("unknown"), reason=reason, **both)

    seen = single.where(~blind)
    o, n = F.col("old"), F.col("new")
    meta = metadata_changed(F.col("old_payloads"), F.col("new_payloads"))
    matched = seen.where("old is not null and new is not null").withColumn("meta", meta)
    hashed = o["hash_hex"].isNotNull() & n["hash_hex"].isNotNull()
    moved_stat = ~o["mtime"].eqNullSafe(n["mtime"]) | ~o["attrs"].eqNullSafe(n["attrs"])
    status = (
        F.when(o["unstable"] | n["unstable"], "unstable").when(~o["size"].eqNullSafe(n["size"]), "content_changed").when(~hashed, "hash_missing").when(o["hash_hex"] != n["hash_hex"], "content_changed")
        .when(moved_stat, "stat_changed_content_same").when(F.col("meta") == 1, "metadata_extraction_changed").otherwise("unchanged")
    )
    grade = F.when(o["unstable"] | n["unstable"], "insufficient").when(~o["size"].eqNullSafe(n["size"]), "stat_only").when(hashed, evidence_of(o["event"], n["event"])).otherwise("insufficient")
    why = F.concat_ws(",", F.when(o["unstable"] | n["unstable"], "unstable"), F.when(o["rel_path"] != n["rel_path"], "case_or_form_rename"))
    same_path = result(matched, path_key=F.col("path_key"), status=status, evidence=grade, reason=F.nullif(why, F.lit("")), metadata_changed=F.col("meta"), **both)

    # What only one side has, and all of roots without a counterpart.
    rest = lambda side, other: seen.where(f"{side} is not null and {other} is null").select("path_key", f"{side}.*", F.lit(side).alias("side"), F.lit(None).cast("string").alias("base_reason"))
    flat = ["path_key", "root_label", *SIDE_COLUMNS[:-1], "side", "base_reason"]
    every = rest("old", "new").unionByName(rest("new", "old")).unionByName(unpaired(lefts, "old").select(*flat)).unionByName(unpaired(rights, "new").select(*flat))
    pending = stored(every, "pending")
    groups = hash_groups(old, new, pending.where("hash_hex is not null").select("hash_hex").distinct())

    # The i-th deleted path of a content pairs with its i-th added one.
    content = ranked(pending.where("hash_hex is not null").withColumn("_key", F.concat("side", "hash_hex")), "_key", ["path_key", "root_label", "rel_path"]).drop("_key")
    gone, came = content.where("side = 'old'").drop("side"), content.where("side = 'new'").drop("side")
    renamed = lambda df, prefix: df.select("hash_hex", "rank", F.struct(*[c for c in df.columns if c != "rank"]).alias(prefix))
    paired = stored(renamed(gone, "old").join(renamed(came, "new"), ["hash_hex", "rank"], "full_outer"), "paired")
    moved = result(paired.where("old is not null and new is not null"), path_key=n["path_key"], status=F.lit("moved_or_renamed"), evidence=evidence_of(o["event"], n["event"]), reason=F.lit("group_paired"), group_hash=F.col("hash_hex"), **both)

    # The rows of a content are told apart by runs of their ranks, and what is known of it is there once a run: the empty file may be a third of an archive.
    run = F.floor(F.col("rank") / ranking.GROUP_ROWS)
    runs = groups.select("hash_hex", "old_count", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest("old_count", "new_count") / ranking.GROUP_ROWS))).alias("_run"))
    surplus = paired.where("old is null").select("new.*", "rank", run.alias("_run")).join(runs, ["hash_hex", "_run"]).drop("_run")
    # Rows that can't have a partner get a key of their own, so that they don't meet in one task.
    alone = F.concat(F.lit("\x00"), F.col("path_key"))
    linked = F.col("volume").isNotNull() & F.col("file_id").isNotNull()
    links = new["entries"].where("hash_hex is not null and coalesce(volume, '') <> '' and coalesce(file_id, '') <> ''").groupBy("hash_hex", "volume", "file_id").count().where("count > 1").select("hash_hex", F.col("volume").alias("_volume"), F.col("file_id").alias("_file"), F.lit(True).alias("is_link"))
    events = old["entries"].where("hash_hex is not null and event is not null").select("hash_hex", F.col("event").alias("_event"), F.lit(True).alias("known_event")).distinct()
    surplus = surplus.withColumns({"_volume": F.when(linked, F.col("volume")), "_file": F.when(linked, F.col("file_id")).otherwise(alone), "_event": F.coalesce("event", alone)})
    surplus = surplus.withColumn("_volume", F.coalesce("_volume", alone)).join(links, ["hash_hex", "_volume", "_file"], "left").join(events, ["hash_hex", "_event"], "left").drop("_volume", "_file", "_event", "rank")
    added = F.when(F.col("is_link"), "added").when(F.col("old_count") >= 1, "copied").otherwise("added")
    added_reason = F.when(F.col("is_link"), "hardlink_same_file_id").when(F.col("old_count") >= 1, F.lit(None)).otherwise(F.when(F.col("unstable"), "unstable_content").otherwise(F.col("base_reason")))
    surplus = stored(surplus.withColumn("status", added).withColumn("reason", added_reason), "surplus")
    copied = surplus.where("status = 'copied'")
    copies = result(copied, path_key=F.col("path_key"), status=F.lit("copied"), evidence=F.when(F.col("known_event"), "propagated_single_computation").otherwise("independent_computation"), group_hash=F.col("hash_hex"), **side_of("new"))

    # Leftovers of both kinds, hashed or not, may still be the same file by volume and file id; two hashes have decided already.
    plain = F.when(F.col("unstable"), "unstable_content").otherwise(F.col("base_reason"))
    keep = ["path_key", "root_label", "rel_path", "size", "mtime", "hash_hex", "volume", "file_id", "origin", "reason"]
    lost = paired.where("new is null").select("old.*").withColumn("reason", plain).select(*keep).unionByName(pending.where("hash_hex is null and side = 'old'").withColumn("reason", plain).select(*keep))
    fresh = surplus.where("status = 'added'").select(*keep).unionByName(pending.where("hash_hex is null and side = 'new'").withColumn("reason", plain).select(*keep))
    same_file = stored(match_file_ids(lost, fresh), "same-file-pairs")
    by_id = result(same_file, path_key=n["path_key"], status=F.lit("moved_or_renamed"), evidence=F.lit("heuristic_file_id"), reason=F.lit("file_id_heuristic"), **both)
    drop = lambda df, side: df.join(same_file.select(f"{side}.root_label", f"{side}.rel_path"), ["root_label", "rel_path"], "left_anti")
    deleted = result(drop(lost, "old"), path_key=F.col("path_key"), status=F.lit("deleted"), reason=F.col("reason"), group_hash=F.col("hash_hex"), **side_of("old"))
    new_rows = result(drop(fresh, "new"), path_key=F.col("path_key"), status=F.lit("added"), reason=F.col("reason"), group_hash=F.col("hash_hex"), **side_of("new"))

    entries = unknown
    for part in (*collided, same_path, moved, copies, by_id, deleted, new_rows):
        entries = entries.unionByName(part)
    return {"entries": entries, "groups": groups, "dirs": compare_dirs(old, new, label), "subtrees": failed_subtrees(old, new, label)}


def match_file_ids(lost: DataFrame, fresh: DataFrame) -> DataFrame:
    """old and new rows that are one file by volume, file id, size and mtime, at least one of the two without a hash.

    Fresh rows choose in the order of their paths; each takes the first lost row
    that is left and fits. A key may have any number of rows: what a fresh row takes follows from counts.

    Unhashed lost rows are taken in their order, and so are hashed ones. Let u of the
    first m lost rows of a key (those behind the last one count as unhashed) be
    unhashed and h of the first m fresh ones hashed. A hashed fresh row takes an unhashed lost
    one. An unhashed one does so only if all hashed lost rows before the next unhashed one
    are taken, which is where u - h is larger than at any fresh row before; so the
    largest u - h so far counts the unhashed pairs.
    """
    named = "coalesce(volume, '') <> '' and coalesce(file_id, '') <> ''"
    key = F.concat_ws("\x1f", *[F.col(k).cast("string") for k in ("volume", "file_id", "size", "mtime")])
    mine = lambda df: df.where(named).withColumn("_key", key)
    met = lambda df, other: mine(df).join(mine(other).select("_key").distinct(), "_key", "left_semi")
    turns = lambda df, kind: stored(ranked(df, "_key", ["path_key", "root_label", "rel_path"]).select("_key", "rank", kind.alias("plain"), F.struct(*lost.columns).alias("row")), "same-file")
    old, new = (turns(met(df, other), F.col("hash_hex").isNull()) for df, other in ((lost, fresh), (fresh, lost)))
    # Number of a lost row among those of its kind.
    of_kind = lambda plain, n: F.when(F.col("plain"), plain).otherwise(n - plain).alias("number")
    old_numbered = running(old, "_key", "rank", F.col("plain").cast("long"), "_u").select("_key", F.col("plain").alias("_takes_plain"), of_kind(F.col("_u"), F.col("rank")), F.col("row").alias("old"))
    beside = new.join(old.select("_key", "rank", F.col("plain").alias("_lost_plain")), ["_key", "rank"], "left")
    counted = running(beside, "_key", "rank", (~F.col("plain")).cast("long"), "_h")
    counted = running(counted, "_key", "rank", F.coalesce("_lost_plain", F.lit(True)).cast("long") - (~F.col("plain")).cast("long"), "_more", "_most")
    takes_plain = ~F.col("plain") | (F.col("_more") > F.col("_most"))
    pairs_of_plain = F.greatest("_more", "_most")
    number = F.when(takes_plain, F.col("_h") + pairs_of_plain).otherwise(F.col("rank") - F.col("_h") - pairs_of_plain)
    wants = counted.select("_key", takes_plain.alias("_takes_plain"), number.alias("number"), F.col("row").alias("new"))
    return wants.join(old_numbered, ["_key", "_takes_plain", "number"]).select("old", "new")


def compare_dirs(old: Side, new: Side, pairs: DataFrame) -> DataFrame:
    """Directories by path key; of several with one key the last by rel_path stands for them."""
    one = lambda df, side: df.groupBy("pair", "root_label", "path_key").agg(F.max(F.struct("rel_path", "enum_status")).alias("d")).select("pair", "path_key", F.col("root_label").alias(f"{side}_root"), F.col("d.rel_path").alias(f"{side}_path"), F.col("d.enum_status").alias(f"{side}_enum"))
    lefts = old["dirs"].join(pairs.withColumnRenamed("old_root", "root_label"), "root_label", "left").withColumnRenamed("new_root", "pair")
    rights = new["dirs"].join(pairs.select(F.col("new_root").alias("root_label"), F.col("new_root").alias("pair")), "root_label", "left")
    both = one(lefts.where("pair is not null"), "old").join(one(rights.where("pair is not null"), "new"), ["pair", "path_key"], "full_outer")
    for dirs, flag in ((lefts.where("pair is not null").drop("root_label").withColumnRenamed("pair", "root_label"), "under_old"), (new["dirs"], "under_new")):
        both = flag_under_failed(both, dirs, "pair", flag)
    has_old, has_new = F.col("old_path").isNotNull(), F.col("new_path").isNotNull()
    status = (
        F.when(has_old & has_new, F.when(F.col("old_enum") != F.col("new_enum"), "enum_status_changed").otherwise("unchanged"))
        .when(has_old, F.when(F.col("under_new"), "unknown").otherwise("deleted")).otherwise(F.when(F.col("under_old"), "unknown").otherwise("added"))
    )
    reason = F.when(has_old & has_new, F.when(F.col("old_path") != F.col("new_path"), "case_or_form_rename")).when(has_old, F.when(F.col("under_new"), "enum_failed_new")).otherwise(F.when(F.col("under_old"), "enum_failed_old"))
    columns = ["path_key", "old_root", "new_root", "old_path", "new_path", "old_enum", "new_enum", "status", "reason"]
    out = both.withColumn("status", status).withColumn("reason", reason).select(*columns)
    for rows, side, word in ((lefts, "old", "deleted"), (rights, "new", "added")):
        alone = one(rows.where("pair is null"), side)
        have = {"status": F.lit(word), "reason": F.lit("unpaired_root")} | {c: F.col(c) for c in alone.columns}
        out = out.unionByName(alone.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in columns]))
    return out


def failed_subtrees(old: Side, new: Side, pairs: DataFrame) -> DataFrame:
    """Directories that couldn't be listed, with the number of the other side's entries at or below them; null without a paired root."""
    out = None
    for name, mine, other, here, there in (("old", old, new, "old_root", "new_root"), ("new", new, old, "new_root", "old_root")):
        failed = mine["dirs"].where("enum_status <> 'ok'").select("root_label", "rel_path", "path_key", "enum_status")
        failed = failed.join(pairs.select(F.col(here).alias("root_label"), F.col(there).alias("other")), "root_label", "left")
        if failed.isEmpty():
            out = out if out is not None else failed.select(F.lit(name).alias("side"), "root_label", "rel_path", "enum_status", F.lit(0).cast("long").alias("affected_estimate"))
            continue
        beside = F.broadcast(failed.select("other").distinct())  # roots: a few rows a side
        up = other["entries"].select(F.col("root_label").alias("other"), "path_key").join(beside, "other", "left_semi").select("other", F.explode(ancestors(F.col("path_key"))).alias("path_key"))
        counted = up.join(failed.select("other", "path_key").distinct(), ["other", "path_key"], "left_semi").groupBy("other", "path_key").agg(F.count("*").alias("n"))
        rows = failed.join(counted, ["other", "path_key"], "left").select(F.lit(name).alias("side"), "root_label", "rel_path", "enum_status", F.when(F.col("other").isNotNull(), F.coalesce("n", F.lit(0))).alias("affected_estimate"))
        out = rows if out is None else out.unionByName(rows)
    return out


def status_evidence(entries: DataFrame) -> DataFrame:
    return entries.groupBy("status", "evidence").agg(F.count("*").alias("n"))


def metadata_evidence(entries: DataFrame) -> DataFrame:
    """Counts of changed, unchanged, unavailable (on both sides, nothing to compare) and not_applicable rows."""
    both = F.col("old_path").isNotNull() & F.col("new_path").isNotNull()
    kind = F.when(F.col("metadata_changed") == 1, "changed").when(F.col("metadata_changed") == 0, "unchanged").when(both, "unavailable").otherwise("not_applicable")
    return entries.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def conclusion(entries: DataFrame, dirs: DataFrame) -> DataFrame:
    """One row: what breaks content and structure, and what leaves either undecided."""
    n = lambda *words: F.count_if(F.col("status").isin(*words))
    files = entries.agg(
        n("content_changed", "added", "deleted", "copied").alias("content_breaking"), n("unknown", "hash_missing", "unstable").alias("content_caveats"),
        n("added", "deleted", "moved_or_renamed", "copied").alias("structure_files"), n("unknown").alias("structure_caveats"),
    )
    folders = dirs.agg(n("added", "deleted").alias("structure_dirs"))
    verdict = lambda breaking, caveats: F.when(F.col(breaking) > 0, "changed").when(F.col(caveats) > 0, "undecided").otherwise("same")
    out = files.join(folders, F.lit(True)).withColumn("structure_breaking", F.col("structure_files") + F.col("structure_dirs")).drop("structure_files", "structure_dirs")
    return out.withColumn("content", verdict("content_breaking", "content_caveats")).withColumn("structure", verdict("structure_breaking", "structure_caveats"))


def issue_rows(entries: DataFrame, limit: int = 500) -> DataFrame:
    """The first unstable and unknown rows by status and path, with the number of all."""
    bad = entries.where("status in ('unstable', 'unknown')")
    top = bad.orderBy("status", "path_key", "old_path", "new_path").limit(limit)
    return top.join(bad.agg(F.count("*").alias("total")), F.lit(True))


def changed_groups(groups: DataFrame) -> DataFrame:
    return groups.where("old_count <> new_count")


def comparison_capabilities(old: DataFrame, new: DataFrame) -> DataFrame:
    """capability, old and new state, whether the two can be compared, and why not. Inputs: capability, state and, where known, reason."""
    side = lambda df, name: df.select("capability", F.col("state").alias(name), (F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")).alias(f"{name}_reason"))
    both = side(old, "old").join(side(new, "new"), "capability", "full_outer").na.fill("unavailable", ["old", "new"])
    there = F.col("old").isin("available", "empty") & F.col("new").isin("available", "empty")
    state = F.when((F.col("old") == "empty") & (F.col("new") == "empty"), "empty").when((F.col("old") == "available") & (F.col("new") == "available"), "comparable").when(F.col("capability").isin("files", "directories") & there, "comparable").otherwise("unavailable")
    said = lambda name: F.when(F.col(name) != "available", F.concat(F.lit(f"{name}="), F.col(name), F.lit(": "), F.coalesce(f"{name}_reason", F.when(F.col(name) == "empty", "executed without a record").otherwise("no reason recorded"))))
    reason = F.when(state == "unavailable", F.nullif(F.concat_ws("; ", said("old"), said("new")), F.lit("")))
    return both.select("capability", "old", "new", state.alias("comparison"), reason.alias("reason"))


def summary_rows(entries: DataFrame, dirs: DataFrame, subtrees: DataFrame, groups: DataFrame) -> DataFrame:
    """section, key and value of a comparison's report: verdicts, files by status and evidence, folders by status, gaps and changed contents."""
    word = conclusion(entries, dirs)
    parts = [
        word.select(F.lit("conclusion").alias("section"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in ("content", "structure", "content_breaking", "structure_breaking", "content_caveats", "structure_caveats")])).alias("x")).select("section", "x.*"),
        status_evidence(entries).select(F.lit("files").alias("section"), F.concat_ws("/", "status", "evidence").alias("key"), F.col("n").cast("string").alias("value")),
        dirs.groupBy(F.lit("directories").alias("section"), F.col("status").alias("key")).agg(F.count("*").cast("string").alias("value")),
        subtrees.select(F.lit("gaps").alias("section"), F.concat_ws("/", "side", "root_label", "rel_path").alias("key"), F.col("affected_estimate").cast("string").alias("value")),
        changed_groups(groups).groupBy(F.lit("contents").alias("section"), F.col("classification").alias("key")).agg(F.count("*").cast("string").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
