"""JSON text and VARIANT helpers: keys, canonical text, tree traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that may not be stored, compared in lower-case letters and digits.
AUTH_KEYS = [
    "password", "passwd", "authorization", "cookie", "cookies", "accesstoken",
    "refreshtoken", "sessiontoken", "apikey", "clientsecret", "authtoken",
]
# Fragments that make a key sensitive.
SENSITIVE_PARTS = [
    "password", "passwd", "authorization", "cookie", "token", "secret",
    "session", "credential", "apikey",
]

_STRING = r'"(?:[^"\\]|\\.)*"'


def plain_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def all_keys(text: Column) -> Column:
    """Every object key of a JSON text, at any depth, unescaped.

    All string tokens are matched in sequence, so text inside values cannot be
    mistaken for a key; the tokens followed by a colon are the keys.
    """
    tokens = F.regexp_extract_all(text, F.lit(rf"({_STRING})(\s*:)?"), F.lit(0))
    keys = F.filter(tokens, lambda t: t.endswith(":"))
    quoted = F.transform(keys, lambda t: F.regexp_replace(t, r"\s*:$", ""))
    return F.transform(
        quoted, lambda t: F.get_json_object(F.concat(F.lit('{"k":'), t, F.lit("}")), "$.k")
    )


def outside_strings(text: Column) -> Column:
    return F.regexp_replace(text, _STRING, '""')


def has_auth_key(text: Column) -> Column:
    """True if any key is one that may not be stored.

    Keys are only taken apart where the letters of a forbidden one occur in the text
    at all, or where an escape could hide them.
    """
    keys = F.transform(all_keys(text), plain_key)
    found = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in AUTH_KEYS]))
    possible = plain_key(text).rlike("|".join(AUTH_KEYS)) | text.contains("\\")
    return F.when(possible, found).otherwise(F.when(text.isNotNull(), F.lit(False)))


def is_object(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def has_duplicate_top_key(text: Column) -> Column:
    keys = F.json_object_keys(text)
    return F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))


def has_unique_keys(text: Column) -> Column:
    """True if the text is JSON without a repeated key in any object.

    ``from_json`` silently keeps the last of two equal keys; the VARIANT parser
    refuses them at every level.
    """
    return F.try_parse_json(text).isNotNull()


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys; VARIANT stores object keys in order."""
    return F.to_json(F.try_parse_json(text))


def is_sensitive(key: Column) -> Column:
    plain = F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")
    return plain.rlike("|".join(SENSITIVE_PARTS))


def _members(node: Column) -> Column:
    """The members of an object; null for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def _items(node: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.try_variant_get(node, "$", "array<variant>")


def variant_type(value: str | Column) -> Column:
    """Only scalars are asked for their schema, which of a tree tells all below it."""
    node = F.col(value) if isinstance(value, str) else value
    kind = F.schema_of_variant(node)
    scalar = (
        F.when(kind == "STRING", "string")
        .when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .otherwise("number")
    )
    return F.when(_members(node).isNotNull(), "object").when(_items(node).isNotNull(), "array").otherwise(scalar)


_NODE = "struct<path:string,key:string,node:variant>"


def depth(text: Column) -> Column:
    """How deep lists and objects of a JSON text are nested; 0 for a scalar."""
    brackets = F.regexp_replace(outside_strings(text), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, "(?<=.)(?=.)"), start, step)["most"]


def nodes_of(value: str, list_items: int | None, plain_paths: bool, deep: Column) -> Column:
    """All nodes of the JSON tree in ``value`` (a VARIANT column), as an array.

    A node has ``path``, ``key`` (null for list items) and ``node``. Sensitive keys and all
    below them are left out. With ``plain_paths`` keys are reduced to letters and
    digits and ``[]`` is a path step of its own; otherwise keys stay as written and
    ``[]`` is glued to its list. ``list_items`` bounds how many items of a list are
    visited (its first ones).

    The tree is unfolded inside the row, from one level to the next, as many levels as
    ``deep`` says of the row. Explode the expression itself: of a column made from it, Spark
    would infer a filter on its size, and unfold every tree twice.
    """
    root = F.struct(
        F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.col(value).alias("node")
    )
    steps = F.array_repeat(F.lit(0), F.coalesce(deep, F.lit(0)))

    def below(levels: Column, _: Column) -> Column:
        children = F.transform(F.element_at(levels, -1), lambda e: _children(e, list_items, plain_paths))
        return F.concat(levels, F.array(F.flatten(children)))

    levels = F.aggregate(steps, F.array(F.array(root)).cast(f"array<array<{_NODE}>>"), below)
    return F.flatten(F.slice(levels, F.lit(2), F.lit(2**30)))


def walk(documents: DataFrame, value: str, list_items: int | None, plain_paths: bool, deep: Column) -> DataFrame:
    """One row per node of the JSON trees, with ``path``, ``key`` and ``node``."""
    nodes = documents.select("*", F.explode(nodes_of(value, list_items, plain_paths, deep)).alias("_n"))
    return nodes.select("*", "_n.*").drop("_n")


def _children(parent: Column, list_items: int | None, plain_paths: bool) -> Column:
    path, node = parent["path"], parent["node"]

    def member(entry: Column) -> Column:
        name = entry["key"]
        if plain_paths:
            plain = plain_key(name)
            name = F.when(plain == "", "field").otherwise(plain)
        full = F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
        return F.struct(full.alias("path"), entry["key"].alias("key"), entry["value"].alias("node"))

    def item(element: Column) -> Column:
        step = F.when(path == "", "[]").otherwise(F.lit(".[]")) if plain_paths else F.lit("[]")
        return F.struct(
            F.concat(path, step).alias("path"),
            F.lit(None).cast("string").alias("key"),
            element.alias("node"),
        )

    members = F.filter(F.map_entries(_members(node)), lambda e: ~is_sensitive(e["key"]))
    items = _items(node)
    if list_items is not None:
        items = F.slice(items, 1, list_items)
    nothing = F.array().cast(f"array<{_NODE}>")
    return F.coalesce(F.transform(members, member), F.transform(items, item), nothing)
