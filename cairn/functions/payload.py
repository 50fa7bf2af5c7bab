"""Column functions on tool payloads (JSON text)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import first_float

#: Tags that change with the place and time of reading.
VOLATILE = ["sourcefile", "directory", "fileaccessdate"]
EMPTY = ["", "n/a"]


def canonical_json(text: Column) -> Column:
    """Keys sorted, without blanks. Numbers are written Spark's way (1.0 as 1): compare with what Spark made."""
    return F.to_json(F.try_parse_json(text))


@F.pandas_udf(StringType())
def legacy_canonical_json(text: pd.Series) -> pd.Series:
    """Canonical JSON as older snapshots wrote it, to check their digests."""

    def of(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(json.loads(s), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(of)


@F.pandas_udf(StringType())
def drop_volatile(text: pd.Series) -> pd.Series:
    """The document without volatile tags, at any depth, in canonical form; null if it isn't JSON."""

    def strip(x: object) -> object:
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k.rpartition(":")[2].casefold() not in VOLATILE}
        return [strip(v) for v in x] if isinstance(x, list) else x

    def of(s: str | None) -> str | None:
        try:
            return None if s is None else json.dumps(strip(json.loads(s)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return text.map(of)


def payload_digest(text: Column) -> Column:
    return F.sha2(drop_volatile(text).cast("binary"), 256)


def value_type(value: Column) -> Column:
    """null, boolean, integer, number, json or text, of a variant."""
    kind = F.schema_of_variant(value)
    return F.when(value.isNull() | (kind == "VOID"), "null").when(kind == "BOOLEAN", "boolean").when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number").when(kind == "STRING", "text").otherwise("json")


def as_json_text(value: Column) -> Column:
    """A scalar as a JSON array of one."""
    return F.when(value.isNotNull(), F.to_json(F.array(value)))


def scalar_or_json(value: Column) -> Column:
    """A variant as text: scalars as they are, others as JSON."""
    return F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))


def tags(payloads: DataFrame, keys: list[str], text: str = "payload") -> DataFrame:
    """keys, family, tag, value and number of every tag: a row a tag.

    Keys of the document read Family:…:Tag. Of several with one family and tag
    those marked Main (or with nothing between) come first, then those that come
    first in the document. The family * stands for any.
    """
    doc = payloads.select(*keys, F.posexplode(F.from_json(text, "map<string,variant>")).alias("_at", "_key", "_raw")).where("_key <> 'SourceFile'")
    parts = F.split("_key", ":")
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    shown = F.coalesce(F.try_variant_get("_raw", "$.val", "variant"), F.col("_raw"))
    doc = doc.select(
        *keys, F.lower(parts[0]).alias("family"), F.lower(F.element_at(parts, -1)).alias("tag"), F.when((F.size(parts) < 3) | (F.lower(F.try_element_at(inner, F.lit(1))) == "main"), 0).otherwise(1).alias("_score"), "_at",
        F.coalesce(F.try_variant_get(shown, "$", "string"), F.to_json(shown)).alias("value"), F.try_variant_get("_raw", "$.num", "string").alias("number"),
    )
    every = doc.withColumn("family", F.explode(F.array("family", F.lit("*"))))
    best = every.groupBy(*keys, "family", "tag").agg(F.min_by(F.struct("value", "number"), F.struct("_score", "_at")).alias("v"))
    return best.select(*keys, "family", "tag", "v.value", "v.number")


def tag_map(tagged: DataFrame, keys: list[str]) -> DataFrame:
    """One row a document: ``tags``, a map from family:tag to struct of value and number."""
    entry = F.struct(F.concat_ws(":", "family", "tag").alias("key"), F.struct("value", "number").alias("value"))
    return tagged.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("tags"))


def _hit(found: Column, spec: str) -> Column:
    return F.try_element_at(found, F.lit(spec.lower()))


def _full(value: Column) -> Column:
    return F.when(~value.isin(EMPTY), value)


def tag_chain(found: Column, specs: list[str]) -> Column:
    """The first value that isn't null, empty or n/a."""
    return F.coalesce(*[_full(_hit(found, s)["value"]) for s in specs])


def tag_number(found: Column, specs: list[str]) -> Column:
    """The first number: the machine's where there is one, else what the text shows."""
    return F.coalesce(*[first_float(F.coalesce(_full(_hit(found, s)["number"]), _hit(found, s)["value"])) for s in specs])


def tag_native_number(found: Column, specs: list[str]) -> Column:
    """The first number that isn't text for display."""
    return F.coalesce(*[F.coalesce(first_float(_full(_hit(found, s)["number"])), _hit(found, s)["value"].try_cast("double")) for s in specs])
