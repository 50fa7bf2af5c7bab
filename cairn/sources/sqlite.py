"""Snapshots in SQLite files: read with the filters and columns that a query needs, imported as bundles, and written.

A path is a file, or a folder of files (``*.sqlite``), on storage that executors mount.
"""

from __future__ import annotations

import base64
import json
import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from .bundle import Bundle
from .schemas import TABLES
from .storage import stored

#: The column that says which file a row is from: numbers of rows mean something in one file only.
FILE = "source_file"
KINDS = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}
COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Columns that such files call otherwise.
CALLED = {"snapshot_info": {"status": "scan_status", "tool_version": "scanner_version", "has_unstable": "has_unstable_entries", "has_gaps": "has_enumeration_gaps"}}


def mounted(path: str) -> str:
    """A path for the operating system, from one that may be a file URI."""
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def files_of(path: str) -> list[str]:
    path = mounted(path)
    return sorted(os.path.join(path, x) for x in os.listdir(path) if x.endswith(".sqlite")) if os.path.isdir(path) else [path]


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def columns_of(path: str, table: str) -> dict[str, str]:
    """Columns of a table by name, with their types in Spark; none if there is no such table."""
    with opened(files_of(path)[0]) as con:
        return {r[1]: KINDS.get(r[2].upper(), "string") for r in con.execute(f"PRAGMA table_info({quoted(table)})")}


class SqliteSource(DataSource):
    """One table of SQLite files: options path, table and rows (of a partition, about)."""

    @classmethod
    def name(cls) -> str:
        return "snapshot_sqlite"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {kind}" for n, kind in ({FILE: "string"} | columns_of(self.options["path"], self.options["table"])).items())

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema.fieldNames())


class Part(InputPartition):
    """Rows of a file whose key is above ``low`` and at most ``high`` (None: no bound)."""

    def __init__(self, file: str, key: list[str], low: tuple | None, high: tuple | None):
        self.file, self.key, self.low, self.high = file, key, low, high


class SqliteReader(DataSourceReader):
    """Reads the columns of its schema, and rows that the pushed filters leave; Spark looks at the filters again."""

    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", "500000"))
        self.columns, self.conditions, self.values = columns, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else FILE
            if name != FILE:
                self._push(f, quoted(name))
            yield f

    def _push(self, f: Filter, column: str) -> None:
        plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
        if type(f) in COMPARED and plain(f.value):
            self.conditions.append(f"{column} COLLATE BINARY {COMPARED[type(f)]} ?")
            self.values.append(f.value)
        elif type(f) is In and 0 < len(f.value) <= 500 and all(map(plain, f.value)):
            self.conditions.append(f"{column} COLLATE BINARY IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif type(f) in (IsNull, IsNotNull):
            self.conditions.append(f"{column} IS {'NOT ' if type(f) is IsNotNull else ''}NULL")

    def partitions(self) -> list[InputPartition]:
        return [part for file in files_of(self.path) for part in self._parts(file)]

    def _parts(self, file: str) -> list[Part]:
        """Runs of about ``rows`` rows by row number or, in tables without one, by primary key."""
        with opened(file) as con:
            made = con.execute(f"PRAGMA table_info({quoted(self.table)})").fetchall()
            try:
                n, low, high = con.execute(f"SELECT count(*), min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                key = [quoted(r[1]) for r in sorted(made, key=lambda r: r[5]) if r[5]]
                names, ends = ", ".join(key), [None]
                while True:
                    after = f"WHERE ({names}) > ({', '.join('?' * len(key))})" if ends[-1] else ""
                    found = con.execute(f"SELECT {names} FROM {quoted(self.table)} {after} ORDER BY {names} LIMIT 1 OFFSET {self.rows - 1}", ends[-1] or ()).fetchone()
                    if not found:
                        break
                    ends.append(found)
                return [Part(file, key, a, b) for a, b in zip(ends, [*ends[1:], None], strict=True)]
            parts = max(1, -(-n // self.rows))
            step = -(-((high or 0) - (low or 0) + 1) // parts)
            cuts = [((low or 0) - 1 + k * step,) for k in range(1, parts)]
            return [Part(file, ["rowid"], a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def statement(self, part: Part) -> tuple[str, list]:
        """The query for a part, and its values."""
        chosen = [quoted(c) for c in self.columns if c != FILE] or ["1"]
        conditions, values = list(self.conditions), list(self.values)
        for sign, bound in ((">", part.low), ("<=", part.high)):
            if bound is not None:
                conditions.append(f"({', '.join(part.key)}) {sign} ({', '.join('?' * len(bound))})")
                values += bound
        return f"SELECT {', '.join(chosen)} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(conditions)}" if conditions else ""), values

    def read(self, partition: Part) -> Iterator[tuple]:
        places = [k for k, c in enumerate(c for c in self.columns if c != FILE)]
        at = self.columns.index(FILE) if FILE in self.columns else None
        with opened(partition.file) as con:
            for row in con.execute(*self.statement(partition)):
                row = row[: len(places)]
                yield row if at is None else (*row[:at], partition.file, *row[at:])


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, where: str | None = None, rows: int = 500_000) -> DataFrame:
    """A table of SQLite files, read once and stored: only ``columns``, and rows for which ``where`` holds, leave the files.

    Spark keeps what it has pushed to a Python source for every later use of the
    same frame, so frames of the source itself aren't handed out.
    """
    spark.dataSource.register(SqliteSource)
    kinds = {FILE: "string"} | columns_of(path, name)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns or kinds)
    df = spark.read.format("snapshot_sqlite").schema(schema).option("path", path).option("table", name).option("rows", rows).load()
    before = spark.conf.get(PUSHDOWN, "false")
    spark.conf.set(PUSHDOWN, "true")
    try:
        return stored(df.where(where) if where else df, f"sqlite-{name}")
    finally:
        spark.conf.set(PUSHDOWN, before)


def import_snapshot(spark: SparkSession, path: str, rows: int = 500_000) -> Bundle:
    """The tables of snapshots in SQLite files as a bundle: row numbers give way to root_label and rel_path.

    Of each table the columns that a bundle knows are read, others are null. A row
    without an entry or directory of its own keeps a null path. Files of one folder are parts of one snapshot: their roots and
    snapshot_info may repeat and are there once.
    """
    have = {t: columns_of(path, t) for t in TABLES}
    read = lambda t, names: table(spark, path, t, names, rows=rows)
    labels = F.broadcast(read("roots", [FILE, "root_id", "root_label"]))  # roots: a few a file
    paths: dict[str, DataFrame] = {}

    def keyed(t: str, n: str) -> DataFrame:
        """Number and path of each row of a table, read once for all that refer to it."""
        if t not in paths:
            paths[t] = read(t, [FILE, n, "root_id", "rel_path"]).join(labels, [FILE, "root_id"]).select(FILE, n, F.struct("root_label", "rel_path").alias(f"_{n}"))
        return paths[t]

    out = {}
    for name, columns in have.items():
        if not columns:
            continue
        wanted = [c.split(" ") for c in TABLES[name].split(", ")]
        called = CALLED.get(name, {})
        numbers = [n for n in ("entry_id", "dir_id", "root_id") if n in columns and n not in dict(wanted)]
        if "rel_path" in columns:
            numbers = [n for n in numbers if n == "root_id"]
        df = read(name, [FILE, *numbers, *[called.get(n, n) for n, _ in wanted if called.get(n, n) in columns]])
        known = {n: F.col(called.get(n, n)) for n, _ in wanted if called.get(n, n) in columns}
        keys = []
        for n in numbers:
            if n == "root_id":
                df = df.join(labels.withColumnRenamed("root_label", "_label"), [FILE, n], "left")
            else:
                df = df.join(keyed("entries" if n == "entry_id" else "dirs", n), [FILE, n], "left")
                keys.append(F.col(f"_{n}"))
        if numbers:
            label = [k["root_label"] for k in keys] + ([F.col("_label")] if "root_id" in numbers else [])
            known.setdefault("root_label", F.coalesce(*label))
        if keys:
            known.setdefault("rel_path", F.coalesce(*[k["rel_path"] for k in keys]))
            if "dir_id" in numbers:
                known.setdefault("is_dir", F.col("dir_id").isNotNull().cast("int"))
        df = df.select(*[known.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in wanted])
        out[name] = df.distinct() if name in ("snapshot_info", "roots") else df
    return out


#: Tables that are written, in the order in which their rows refer to each other.
WRITTEN = ["roots", "dirs", "entries", "hashes", "raw_payloads"]
ENTRY_TABLES = ("hashes", "raw_payloads")


def export_snapshot(bundle: Bundle, folder: str, files: int) -> DataFrame:
    """Write a bundle as SQLite files, each with a share of the entries and all that belongs to these; a row for each file.

    Every task makes its file in memory and gives it its name when it is whole. The path of an entry decides which file it goes to.
    """
    spark = bundle["snapshot_info"].sparkSession
    info = [bundle["snapshot_info"].first().asDict()]  # one row
    roots = [r.asDict() for r in bundle["roots"].collect()]  # a few
    rows = None
    for order, name in enumerate(WRITTEN[1:]):
        df = bundle[name]
        binary = [c for c, kind in df.dtypes if kind == "binary"]
        said = F.to_json(F.struct(*[F.base64(c).alias(c) if c in binary else F.col(c) for c in df.columns]))
        part = df.select(F.lit(order).alias("n"), F.lit(name).alias("name"), "root_label", "rel_path", said.alias("said"))
        rows = part if rows is None else rows.unionByName(part)
    folder = mounted(folder)
    kinds = {n: dict(c.split(" ") for c in TABLES[n].split(", ")) for n in ["snapshot_info", *WRITTEN]}

    def create(con: sqlite3.Connection, name: str) -> None:
        native = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "binary": "BLOB"}
        own = {CALLED.get(name, {}).get(c, c): native.get(kind, "TEXT") for c, kind in kinds[name].items()}
        number = {"roots": "root_id", "dirs": "dir_id", "entries": "entry_id"}.get(name)
        drop = ("root_label", "rel_path") if name in ENTRY_TABLES else ("root_label",) if name in ("dirs", "entries") else ()
        parts = [f"{number} INTEGER PRIMARY KEY"] if number else []
        parts += ["root_id INTEGER"] if name in ("dirs", "entries") else ["entry_id INTEGER"] if name in ENTRY_TABLES else []
        parts += [f"{c} {kind}" for c, kind in own.items() if c not in drop]
        # Tables of an entry's parts have no row numbers of their own.
        key = {"hashes": ", PRIMARY KEY (entry_id, algorithm)) WITHOUT ROWID", "raw_payloads": ", PRIMARY KEY (entry_id, provider)) WITHOUT ROWID"}.get(name, ")")
        con.execute(f"CREATE TABLE {name} ({', '.join(parts)}{key}")

    def insert(con: sqlite3.Connection, name: str, row: dict) -> None:
        row = {CALLED.get(name, {}).get(c, c): base64.b64decode(v) if kinds[name].get(c) == "binary" and v is not None else v for c, v in row.items()}
        con.execute(f"INSERT INTO {name} ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", list(row.values()))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        con, number, n = sqlite3.connect(":memory:"), {}, 0
        root_of = {r["root_label"]: k for k, r in enumerate(roots, 1)}
        for name in ["snapshot_info", *WRITTEN]:
            create(con, name)
        for row in info:
            insert(con, "snapshot_info", row)
        for row in roots:
            insert(con, "roots", row | {"root_id": root_of[row["root_label"]]})
        for batch in batches:
            for name, label, path, said in zip(batch.name, batch.root_label, batch.rel_path, batch.said, strict=True):
                row = json.loads(said)
                row.pop("root_label", None)
                if name in ENTRY_TABLES:
                    row.pop("rel_path", None)
                    insert(con, name, row | {"entry_id": number[label, path]})
                    continue
                if name == "entries":
                    number[label, path] = n = n + 1
                insert(con, name, row | {"root_id": root_of[label]} | ({"entry_id": n} if name == "entries" else {}))
        con.commit()
        if not n:
            return
        place = TaskContext.get().partitionId()
        partial = os.path.join(folder, f"part-{place:05}.{uuid.uuid4().hex}.partial")
        os.makedirs(folder, exist_ok=True)
        with open(partial, "wb") as f:
            f.write(con.serialize())
        os.replace(partial, os.path.join(folder, f"part-{place:05}.sqlite"))
        yield pd.DataFrame({"file": [f"part-{place:05}.sqlite"], "entries": [n]})

    dealt = rows.repartition(files, F.xxhash64("root_label", "rel_path")).sortWithinPartitions("n", "root_label", "rel_path")
    return dealt.mapInPandas(write, "file string, entries bigint")
