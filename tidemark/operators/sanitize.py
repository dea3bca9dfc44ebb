"""Bulk sanitising and profiling of URLs, JSON payloads and bytes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import columns as C
from tidemark.functions import documents as J

# Allow-listed keys, in lower-case letters and digits.
NUMERIC_KEYS = [
    "multiplier", "crashmultiplier", "crashpoint", "coefficient", "coef",
    "payoutmultiplier", "finalmultiplier", "resultmultiplier", "nextmultiplier",
]
IDENTIFIER_KEYS = [
    "roundid", "nextroundid", "gameid", "gamehash", "hash", "commitment",
    "serverseedhash", "clientseedhash",
]
STATE_KEYS = [
    "event", "eventtype", "type", "state", "status", "phase", "action", "method",
    "command", "cmd", "topic", "messagetype", "gamestate", "roundstate",
]


def strip_url(url: Column) -> Column:
    """URL without query string and fragment."""
    return F.regexp_replace(url, r"[?#][\s\S]*$", "")


def _parsed(documents: DataFrame, text: str) -> DataFrame:
    return documents.withColumn("_doc", F.try_parse_json(text)).where(F.col("_doc").isNotNull())


def _levels(text: str, max_depth: int | None) -> Column:
    deep = J.depth(F.col(text))
    return deep if max_depth is None else F.least(deep, F.lit(max_depth))


def _pairs(text: str, list_items: int | None, max_depth: int | None) -> Column:
    """The distinct (path, type) of the JSON tree in ``_doc``."""
    nodes = J.nodes_of("_doc", list_items, False, _levels(text, max_depth))
    pair = F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), J.variant_type(n["node"]).alias("type")))
    return F.array_distinct(pair)


def document_paths(
    documents: DataFrame, text: str = "text", list_items: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """(path, type) of every key of every document, each once.

    All items of lists are seen, or the first ``list_items``, and all levels, or the first
    ``max_depth``.
    """
    nodes = _parsed(documents, text).select("*", F.explode(_pairs(text, list_items, max_depth)).alias("_p"))
    return nodes.select(*documents.columns, "_p.path", "_p.type")


def json_path_inventory(
    documents: DataFrame, text: str = "text", key: str = "doc_id", by: Sequence[str] = ("series",),
    list_items: int | None = None, max_depth: int | None = None,
) -> DataFrame:
    """Per (path, type): number of documents and share of the group's parsed documents.

    The paths of a document are made distinct inside its row, so counting rows counts
    documents, without a shuffle of single paths. Items and depth as in ``document_paths``.
    """
    by = list(by)
    parsed = _parsed(documents.select(*by, key, text), text)
    if by:
        parsed = parsed.where(C.all_of([F.col(b).isNotNull() for b in by]))
    # A pair without path counts the document itself, so trees are read once.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("type")))
    found = F.explode(F.concat(_pairs(text, list_items, max_depth), whole))
    counts = parsed.select(*by, found.alias("_p")).groupBy(*by, "_p.path", "_p.type").agg(F.count("*").alias("documents"))
    group = Window.partitionBy(*(by or [F.lit(0)]))
    totals = F.max(F.when(F.col("path").isNull(), F.col("documents"))).over(group)
    share = F.bround(F.col("documents") / F.col("parsed_documents"), 6)
    joined = counts.withColumn("parsed_documents", totals).where("path IS NOT NULL")
    return joined.withColumn("coverage", share)


def _fields(
    documents: DataFrame, text: str, keys: list[str], list_items: int | None, max_depth: int | None
) -> DataFrame:
    """Nodes of the keys, of all list items unless only the first ``list_items`` are wanted."""
    nodes = J.walk(_parsed(documents, text), "_doc", list_items, True, _levels(text, max_depth))
    return nodes.where(F.col("key").isNotNull() & J.plain_key(F.col("key")).isin(keys))


def _scalar(kind: Column) -> Column:
    return kind.isin("string", "number")


def extract_numeric_fields(
    documents: DataFrame, text: str = "text", list_items: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """Allow-listed numeric fields; text such as ``2.5x`` counts, range 0 to 1e6."""
    rows = _fields(documents, text, NUMERIC_KEYS, list_items, max_depth)
    kind = J.variant_type("node")
    shown = F.expr("try_variant_get(node, '$', 'string')")
    number = F.regexp_replace(F.trim(shown), "[xX]+$", "").try_cast("double")
    rows = rows.where(_scalar(kind)).withColumn("value", number)
    return rows.where(F.col("value").between(0.0, 1e6)).select(
        *documents.columns, "path", F.lit("numeric").alias("kind"), "value"
    )


def hash_identifiers(
    documents: DataFrame, text: str = "text", list_items: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """Allow-listed identifiers as the first 24 hex digits of SHA-256, and their length."""
    rows = _fields(documents, text, IDENTIFIER_KEYS, list_items, max_depth)
    shown = F.expr("try_variant_get(node, '$', 'string')")
    return rows.where(_scalar(J.variant_type("node"))).select(
        *documents.columns,
        "path",
        F.lit("identifier_hash").alias("kind"),
        F.substring(F.sha2(shown, 256), 1, 24).alias("sha256_24"),
        F.octet_length(shown).alias("length"),
    )


def extract_categories(
    documents: DataFrame, text: str = "text", list_items: int | None = None, max_depth: int | None = None
) -> DataFrame:
    """Allow-listed short state words, lower-cased; nothing that looks like a token."""
    rows = _fields(documents, text, STATE_KEYS, list_items, max_depth)
    word = F.trim(F.expr("try_variant_get(node, '$', 'string')"))
    compact = F.regexp_replace(F.lower(word), "[^a-z0-9]", "")
    hexadecimal = (F.length(compact) >= 20) & compact.rlike("^[0-9a-f]+$")
    rows = rows.where(J.variant_type("node") == "string").where(
        word.rlike(r"^[A-Za-z0-9_.:\-]{1,48}$") & ~hexadecimal
    )
    return rows.select(*documents.columns, "path", F.lower(word).alias("value"))


def reject_auth_keys(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with a key, at any depth, that may not be stored."""
    return documents.where(J.has_auth_key(F.col(text)))


def payload_digest(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Length, SHA-256, format (text, json or binary) and JSON root type of a payload."""
    if dict(payloads.dtypes)[payload] == "binary":
        kind, root = F.lit("binary"), F.lit(None).cast("string")
    else:
        doc = F.try_parse_json(payload)
        kind = F.when(doc.isNotNull(), "json").otherwise("text")
        root = F.when(
            doc.isNotNull(), J.variant_type(doc)
        )
    return payloads.withColumns(
        {
            "bytes": F.octet_length(payload).cast("bigint"),
            "sha256": F.sha2(F.col(payload), 256),
            "format": kind,
            "root_type": root,
        }
    )


def payload_formats(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Counts and sizes by format and root type."""
    rows = payload_digest(payloads, payload)
    return rows.groupBy("format", "root_type").agg(
        F.count("*").alias("payloads"), F.sum("bytes").cast("bigint").alias("total_bytes")
    )


def repeated_payloads(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Digests that occur more than once, with their number of copies."""
    rows = payload_digest(payloads, payload)
    groups = rows.groupBy("sha256", "bytes").agg(F.count("*").alias("copies"))
    return groups.where(F.col("copies") > 1)


def _bucket_ratio(value: Column) -> Column:
    return F.bround(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) / 0.05) * 0.05, 2)


def _profile(length: Column, entropy: Column, printable: Column, zero: Column, high: Column, unique: Column) -> list[Column]:
    """Coarse buckets, so that no byte distribution can be reconstructed."""

    def share(count: Column) -> Column:
        return F.when(length > 0, _bucket_ratio(count / length)).otherwise(0.0)

    return [
        length.alias("bytes"),
        F.bround(F.bround(F.coalesce(entropy, F.lit(0.0)) / 0.25) * 0.25, 2).alias("entropy_bucket"),
        share(printable).alias("printable_ratio_bucket"),
        share(zero).alias("zero_ratio_bucket"),
        share(high).alias("high_bit_ratio_bucket"),
        F.least(F.lit(256), F.floor((unique + 7) / 8) * 8).cast("int").alias("unique_byte_bucket"),
    ]



@F.arrow_udf(T.ArrayType(T.LongType()))
def byte_histogram(payload: pa.Array) -> pa.Array:
    """How often each of the 256 byte values occurs in each payload.

    Bytes are counted where Arrow has them; nothing is copied into objects of single rows.
    """
    counts = np.zeros((len(payload), 256), dtype=np.int64)
    for i, raw in enumerate(payload):
        if raw.is_valid:
            counts[i] = np.bincount(np.frombuffer(raw.as_buffer(), dtype=np.uint8), minlength=256)
    edges = pa.array(np.arange(0, counts.size + 1, 256, dtype=np.int32))
    return pa.ListArray.from_arrays(edges, pa.array(counts.ravel()))


def _histogram(rows: DataFrame, payload: str) -> Column:
    kind = dict(rows.dtypes)[payload]
    raw = F.col(payload) if kind == "binary" else F.encode(F.col(payload), "UTF-8")
    return byte_histogram(raw)


def byte_profile(rows: DataFrame, payload: str, key: str) -> DataFrame:
    """Byte profile of each payload (text counts as its UTF-8 bytes); no shuffle."""
    counted = rows.select(key, _histogram(rows, payload).alias("_h"))
    counted = counted.withColumn("_n", F.aggregate("_h", F.lit(0).cast("bigint"), lambda a, n: a + n))
    length = F.col("_n").cast("double")

    def part(first: int, last: int) -> Column:
        inside = F.slice("_h", first + 1, last - first + 1)
        return F.aggregate(inside, F.lit(0).cast("bigint"), lambda a, n: a + n)

    used = F.filter("_h", lambda n: n > 0)
    entropy = F.aggregate(used, F.lit(0.0), lambda a, n: a - (n / length) * F.log2(n / length))
    return counted.select(
        key,
        *_profile(F.col("_n"), entropy, part(32, 126), part(0, 0), part(128, 255), F.size(used)),
    )


def byte_profile_by(rows: DataFrame, payload: str, by: Sequence[str]) -> DataFrame:
    """Byte profile of all payloads of a group together: at most 256 counts per group."""
    by = list(by)
    counted = rows.select(*by, F.posexplode(_histogram(rows, payload)).alias("byte", "n"))
    counted = counted.where(F.col("n") > 0)
    totals = counted.groupBy(*by, "byte").agg(F.sum("n").alias("n"))
    totals = totals.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))

    def part(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return totals.groupBy(*by).agg(
        *_profile(
            F.sum("n"),
            F.sum(-F.col("p") * F.log2("p")),
            part(F.col("byte").between(32, 126)),
            part(F.col("byte") == 0),
            part(F.col("byte") >= 128),
            F.count("*"),
        )
    )
