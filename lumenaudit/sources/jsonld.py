"""JSON-LD blocks as nodes, in VARIANT columns: lists and graphs are unfolded in the row that holds them, or to any depth level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.sources.storage import stored

#: Levels of lists and graphs that are unfolded within a row.
LEVELS = 4
MOST_JSON, SAMPLE = 8000, 180
NODES = "array<struct<types:array<string>,id:string,name:string,raw:string>>"
c = F.col


def _kind(v: Column) -> Column:
    return F.substring(F.schema_of_variant(v), 1, 5)  # ARRAY, OBJEC or a scalar's type


def _filled(v: Column) -> Column:
    """Whether a value counts as there: not null, false, 0 or empty."""
    return v.isNotNull() & ~F.is_variant_null(v) & ~F.to_json(v).isin("false", "0", "0.0", '""')


def _graph(v: Column) -> Column:
    return F.try_variant_get(v, "$['@graph']", "variant")


def _folded(v: Column) -> Column:
    return (_kind(v) == "ARRAY") | ((_kind(v) == "OBJEC") & _filled(_graph(v)))


def _unfolded(values: Column) -> Column:
    """One level: lists give their elements, graphs what they hold; empty values go."""
    one = lambda v: F.when(~_filled(v), F.array().cast("array<variant>")).when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(_folded(v), F.array(_graph(v))).otherwise(F.array(v))
    return F.flatten(F.transform(values, one))


def _text(v: Column, key: str) -> Column:
    """A filled value of a node as text."""
    got = F.try_variant_get(v, f"$['{key}']", "variant")
    return F.when(_filled(got), F.coalesce(F.try_variant_get(v, f"$['{key}']", "string"), F.to_json(got)))


def _types(v: Column) -> Column:
    kind = F.try_variant_get(v, "$['@type']", "variant")
    many = F.try_variant_get(v, "$['@type']", "array<string>")
    return F.when((_kind(kind) == "ARRAY") & (F.size(many) > 0), many).when((_kind(kind) == "ARRAY") | ~_filled(kind), F.array(F.lit("Unknown"))).otherwise(F.array(_text(v, "@type")))


def node(v: Column) -> Column:
    raw = F.to_json(v)
    one = F.struct(_types(v).alias("types"), _text(v, "@id").alias("id"), F.coalesce(_text(v, "name"), _text(v, "legalName"), _text(v, "headline")).alias("name"), F.when(F.length(raw) <= MOST_JSON, raw).otherwise("{}").alias("raw"))
    plain = F.struct(F.array(F.lit("Unknown")).alias("types"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), raw.alias("raw"))
    return F.when(_kind(v) == "OBJEC", one).otherwise(plain)


def with_nodes(pages: DataFrame, blocks: str) -> DataFrame:
    """``pages`` with ``nodes`` and ``invalid`` of the JSON texts in the array column ``blocks``, without a shuffle. What is nested deeper than ``LEVELS`` counts as one node; ``nodes`` knows no such bound."""
    invalid = F.transform(F.filter(blocks, lambda b: F.try_parse_json(b).isNull()), lambda b: F.struct(F.lit("invalid JSON").alias("message"), F.substring(b, 1, SAMPLE).alias("sample")))
    values = F.filter(F.transform(blocks, F.try_parse_json), lambda v: v.isNotNull())
    rows = pages.withColumns({"invalid": invalid, "__values": values})
    for _ in range(LEVELS):
        rows = rows.withColumn("__values", _unfolded(c("__values")))
    return rows.withColumn("nodes", F.transform("__values", node)).drop("__values")


def nodes(blocks: DataFrame, key: str, block: str = "block") -> DataFrame:
    """``key, at, types, id, name, raw`` of every node of JSON texts, to any depth; ``at`` is the path of places that leads to it. A pass over what is still folded unfolds a level; only folded values are read again."""
    pending = blocks.select(key, F.array().cast("array<int>").alias("at"), F.try_parse_json(block).alias("v")).where(c("v").isNotNull() & _filled(c("v")))
    found = None
    while True:
        pending = stored(pending)
        flat = pending.where(~_folded(c("v"))).select(key, "at", node(c("v")).alias("n")).select(key, "at", "n.*")
        found = flat if found is None else found.unionByName(flat)
        folded = pending.where(_folded(c("v")))
        if folded.isEmpty():
            return found
        pending = folded.select(key, "at", F.posexplode(_unfolded(F.array("v"))).alias("k", "v")).where(_filled(c("v"))).select(key, F.array_append("at", c("k")).alias("at"), "v")


def bad_blocks(blocks: DataFrame, key: str, block: str = "block") -> DataFrame:
    """``key, sample`` of texts that aren't JSON; blank ones don't count."""
    return blocks.where((F.trim(block) != "") & F.try_parse_json(block).isNull()).select(key, F.substring(block, 1, SAMPLE).alias("sample"))
