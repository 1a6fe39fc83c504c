"""Finding a list inside a JSON tree of unknown shape, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

NOT_JSON = ""
#: Levels of the tree that are opened between two looks at whether any are left.
LEVELS = 4

_NODE = "struct<path:array<int>,text:string,list:boolean>"
_HIT = "struct<path:array<int>,text:string>"


def _kind(value: Column) -> Column:
    """list, object or other, of a variant."""
    as_type = lambda kind: F.try_variant_get(value, "$", kind).isNotNull()
    return F.when(as_type("array<variant>"), "list").when(as_type("map<string,variant>"), "object").otherwise("other")


def _entries(node: Column, component: str, field: str) -> Column:
    """Children of a node that may matter, in the order of the document: (at, key, text, kind).

    One reader gives their texts, one their kinds: a text that looks like JSON is no node. Both read a map, which keeps
    the order of keys as a variant does not.
    """

    def zipped(keys: Column, texts: Column, variants: Column) -> Column:
        both = F.arrays_zip(keys.alias("key"), texts.alias("text"), variants.alias("value"))
        numbered = F.transform(both, lambda e, i: F.struct(i.alias("at"), e["key"].alias("key"), e["text"].alias("text"), e["value"].alias("value")))
        asked = F.filter(numbered, lambda e: F.contains(e["text"], F.lit(component)) | (e["key"] == field))
        return F.transform(asked, lambda e: F.struct(e["at"].alias("at"), e["key"].alias("key"), e["text"].alias("text"), _kind(e["value"]).alias("kind")))

    texts, variants = F.from_json(node["text"], "array<string>"), F.from_json(node["text"], "array<variant>")
    by_name, value_by_name = F.from_json(node["text"], "map<string,string>"), F.from_json(node["text"], "map<string,variant>")
    return F.when(node["list"], zipped(F.transform(texts, lambda t: F.lit(None).cast("string")), texts, variants)).otherwise(
        zipped(F.map_keys(by_name), F.map_values(by_name), F.map_values(value_by_name))
    )


def _one_level(df: DataFrame, component: str, field: str) -> DataFrame:
    """Open the nodes in ``_open``: keep the first hit so far in ``_best``, and the children that may hold one."""

    def hit(node: Column) -> Column:
        named = F.exists(node["entries"], lambda e: (e["key"] == "component") & (e["kind"] == "other") & (e["text"] == component))
        lists = F.filter(node["entries"], lambda e: (e["key"] == field) & (e["kind"] == "list"))
        return F.struct(node["path"].alias("path"), F.when(named, F.get(lists, F.lit(0))["text"]).alias("text"))

    def children(node: Column) -> Column:
        may_hold = F.filter(node["entries"], lambda e: (e["kind"] != "other") & F.contains(e["text"], F.lit(component)))
        return F.transform(
            may_hold,
            lambda e: F.struct(F.array_append(node["path"], e["at"]).alias("path"), e["text"].alias("text"), (e["kind"] == "list").alias("list")),
        )

    entries = F.transform("_open", lambda n: F.struct(n["path"].alias("path"), _entries(n, component, field).alias("entries")))
    opened = df.withColumn("_nodes", entries)
    hits = F.filter(F.transform("_nodes", hit), lambda h: h["text"].isNotNull())
    # A path is smaller than all paths below and after it; nulls are passed over.
    return opened.withColumns(
        {"_best": F.array_min(F.array_append(hits, F.col("_best"))), "_open": F.flatten(F.transform("_nodes", children))}
    ).drop("_nodes")


def find_list(df: DataFrame, text: str, out: str, component: str = "product-list", field: str = "products") -> DataFrame:
    """``df`` with the JSON text of the first ``field`` array beside ``"component": component`` in ``out``.

    First in the order of the document, an object before what it holds. Null when there is none, ``NOT_JSON`` when the text
    is not JSON (a key that stands twice in an object counts as such). The text itself is kept for these only.

    All nodes of a level that name the component are opened at once, inside their row; levels go on until none is open.
    """
    # Only a document that names the component can hold the list; an escape may hide the name.
    named = F.contains(text, F.lit(component)) | F.contains(text, F.lit("\\u"))
    root = F.struct(F.array().cast("array<int>").alias("path"), F.col(text).alias("text"), (F.col("_kind") == "list").alias("list"))
    value = F.try_parse_json(text)
    now = df.withColumn("_kind", F.when(value.isNotNull(), _kind(value))).withColumns(
        {
            "_open": F.when((F.col("_kind") != "other") & named, F.array(root)).otherwise(F.array()).cast(f"array<{_NODE}>"),
            "_best": F.lit(None).cast(_HIT),
            text: F.when(F.col("_kind").isNull(), F.col(text)),
        }
    )
    while True:
        for _ in range(LEVELS):
            now = _one_level(now, component, field)
        now = settle(now)
        if now.filter(F.size("_open") > 0).isEmpty():
            break
    found = F.when(F.col("_kind").isNull() & F.col(text).isNotNull(), F.lit(NOT_JSON)).otherwise(F.col("_best.text"))
    return now.withColumn(out, found).drop("_kind", "_open", "_best")
