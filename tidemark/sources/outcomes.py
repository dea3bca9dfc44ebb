"""Reading, checking, storing and exporting outcomes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import documents as J
from tidemark.schemas import (
    DOCUMENT_KEYS,
    OUTCOME_COLUMNS,
    REQUIRED_DOCUMENT_KEYS,
    STORED_VALUE_TYPE,
)

FORMAT_VERSION = 1
KEY = ["series", "outcome_id"]
ORDER = ["ts", "series", "outcome_id"]
PAYLOADS = ["pre_data", "post_data", "raw_data"]
TIMES = ["ts", "collection_ts", "started_at", "pre_observed_at"]

_OFFSET = r"(?i)([zZ]|[+-]\d{2}:?\d{2}(:?\d{2})?)$"
_DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


class InvalidOutcomes(ValueError):
    """A strict read found records that break a rule."""


class OutcomeConflict(ValueError):
    """A key is already stored, or occurs twice in the batch, with other contents."""


def read_outcome_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of versioned JSON documents, one document per file, all values as text.

    ``document_error`` names what is wrong with the document or the row; a broken
    document yields one row without values. Files and rows are not limited in size.
    """
    files = spark.read.text(paths, wholetext=True).select(
        F.regexp_replace("value", "^﻿", "").alias("text"),
        F.col("_metadata.file_path").alias("file"),
    )
    documents = files.withColumn("doc", F.try_parse_json("text"))
    keys = F.array_sort(F.json_object_keys("text"))
    version = F.expr("schema_of_variant(try_variant_get(doc, '$.format_version', 'variant'))")
    rows = F.expr("try_variant_get(doc, '$.rounds', 'array<variant>')")
    number = F.expr("try_variant_get(doc, '$.format_version', 'int')")
    error = (
        F.when(F.col("doc").isNull(), _broken_json("text"))
        .when(
            keys.isNull() | (keys != F.array(F.lit("format_version"), F.lit("rounds"))),
            "INVALID_DOCUMENT_FIELDS",
        )
        .when((version != "BIGINT") | (number != FORMAT_VERSION), "UNSUPPORTED_FORMAT_VERSION")
        .when(rows.isNull(), "ROUNDS_MUST_BE_ARRAY")
    )
    documents = documents.select(
        "file", error.alias("error"), F.when(error.isNull(), rows).alias("rows")
    )
    exploded = documents.select("file", "error", F.posexplode_outer("rows").alias("at", "row"))
    return exploded.select(
        *[_document_value(key).alias(name) for key, name in DOCUMENT_KEYS.items()],
        "file",
        (F.col("at") + 1).alias("row_number"),
        F.coalesce("error", _row_error()).alias("document_error"),
    ).where(F.col("row_number").isNotNull() | F.col("document_error").isNotNull())


def _broken_json(text: str) -> Column:
    """Duplicate keys and non-finite numbers also fail the parser; tell them apart."""
    return (
        F.when(J.has_duplicate_top_key(F.col(text)), "DUPLICATE_JSON_KEY")
        .when(J.outside_strings(F.col(text)).rlike(r"\b(NaN|Infinity)\b"), "NONFINITE_JSON_NUMBER")
        .otherwise("INVALID_JSON")
    )


def _document_value(key: str) -> Column:
    kind = F.expr(f"schema_of_variant(try_variant_get(row, '$.{key}', 'variant'))")
    text = F.expr(f"try_variant_get(row, '$.{key}', 'string')")
    if key.endswith("_data"):
        missing = F.expr(f"try_variant_get(row, '$.{key}', 'variant')").isNull()
        return F.when(missing, "{}").otherwise(
            F.to_json(F.expr(f"try_variant_get(row, '$.{key}', 'variant')"))
        )
    return F.when(kind == "STRING", text)


def _row_error() -> Column:
    text = F.to_json("row")
    keys = F.json_object_keys(text)
    required = F.array(*[F.lit(k) for k in REQUIRED_DOCUMENT_KEYS])
    known = F.array(*[F.lit(k) for k in DOCUMENT_KEYS])
    value_kind = F.expr("schema_of_variant(try_variant_get(row, '$.multiplier', 'variant'))")
    return (
        F.when(F.col("row").isNull(), None)
        .when(keys.isNull(), "ROUND_MUST_BE_OBJECT")
        .when(F.size(F.array_except(required, keys)) > 0, "MISSING_ROUND_FIELD")
        .when(F.size(F.array_except(keys, known)) > 0, "UNKNOWN_ROUND_FIELD")
        .when(value_kind != "STRING", "MULTIPLIER_MUST_BE_STRING")
    )


def _instant(name: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(text.rlike(_OFFSET), F.try_to_timestamp(text))


def _stored_value(name: str) -> Column:
    return F.expr(f"try_cast(trim({name}) as {STORED_VALUE_TYPE})")


def check_outcomes(raw: DataFrame) -> DataFrame:
    """Add ``errors``: the codes of all rules a raw text record breaks.

    Decimals beyond 38 digits (20 before the point, 18 after) are refused with
    DECIMAL_PRECISION, never rounded.
    """
    # What several rules look at is computed once, in a projection of its own.
    seen_once = {f"_{n}": _instant(n) for n in TIMES}
    seen_once |= {f"_object_{n}": J.is_object(F.col(n)) for n in PAYLOADS}
    seen_once |= {
        "_number": F.coalesce(F.trim(F.col("value")).rlike(_DECIMAL), F.lit(False)),
        "_plain": F.expr("try_cast(trim(value) as double)"),
    }
    facts = raw.withColumns(seen_once)
    value, is_number, plain = F.trim(F.col("value")), F.col("_number"), F.col("_plain")
    written = F.length(F.regexp_replace(F.regexp_extract(value, r"\.(\d*)", 1), "0+$", ""))
    ts, collected, started, seen = (F.col(f"_{n}") for n in TIMES)
    rules: list[tuple[Column, str]] = []
    for name in KEY:
        text = F.col(name)
        rules.append((text.isNull() | (F.trim(text) == ""), f"{name.upper()}_EMPTY"))
        rules.append((text.rlike(r"[\x00-\x1f\x7f]"), f"{name.upper()}_CONTROL_CHARACTER"))
    rules.append((ts.isNull(), "TS_INVALID"))
    rules.append((collected.isNull(), "COLLECTION_TS_INVALID"))
    rules.append((F.col("started_at").isNotNull() & started.isNull(), "STARTED_AT_INVALID"))
    rules.append((F.col("pre_observed_at").isNotNull() & seen.isNull(), "PRE_OBSERVED_AT_INVALID"))
    rules.append((~is_number, "VALUE_INVALID"))
    rules.append((is_number & (plain < 1), "VALUE_BELOW_ONE"))
    tiny = value.rlike("[eE]-(1[89]|[2-9][0-9])")
    too_long = _stored_value("value").isNull() | (written > 18) | tiny
    rules.append((is_number & (plain >= 1) & too_long, "DECIMAL_PRECISION"))
    for name in PAYLOADS:
        code, text, is_object = name.upper(), F.col(name), F.col(f"_object_{name}")
        rules.append((~is_object, f"{code}_NOT_OBJECT"))
        rules.append((is_object & ~J.has_unique_keys(text), f"{code}_DUPLICATE_KEY"))
        rules.append((J.has_auth_key(text), f"{code}_AUTH_KEY"))
    rules.append((collected < ts, "COLLECTION_BEFORE_RESULT"))
    rules.append((started > ts, "START_AFTER_RESULT"))
    filled = F.col("_object_pre_data") & ~F.col("pre_data").rlike(r"^\s*\{\s*\}\s*$")
    rules.append((filled & F.col("pre_observed_at").isNull(), "PRE_DATA_WITHOUT_TIME"))
    late = F.col("started_at").isNull() | (seen >= started)
    rules.append((F.col("pre_observed_at").isNotNull() & late, "PRE_NOT_BEFORE_START"))
    # Joined text skips nulls inside generated code; an array would be built row by row.
    codes = F.concat_ws(",", *[F.when(bad, F.lit(code)) for bad, code in rules])
    none = F.array().cast("array<string>")
    checked = facts.withColumn("_codes", codes)
    errors = F.when(F.col("_codes") == "", none).otherwise(F.split("_codes", ","))
    return checked.withColumn("errors", errors).drop("_codes", *seen_once)


def canonicalise(raw: DataFrame) -> DataFrame:
    """Typed canonical outcomes: trimmed keys, UTC instants, sorted-key JSON."""
    return raw.select(
        *[F.trim(F.col(n)).alias(n) for n in KEY],
        _stored_value("value").alias("value"),
        *[_instant(n).alias(n) for n in TIMES],
        *[J.canonical(F.col(n)).alias(n) for n in PAYLOADS],
    )


def validate_outcomes(raw: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split raw records into canonical outcomes and a quarantine with error codes.

    With ``strict`` any broken record fails the whole batch.
    """
    checked = check_outcomes(raw)
    good = canonicalise(checked.where(F.size("errors") == 0))
    quarantine = checked.where(F.size("errors") > 0)
    if strict and not quarantine.isEmpty():
        raise InvalidOutcomes("The batch contains invalid records.")
    return good, quarantine


def text_form(outcomes: DataFrame) -> DataFrame:
    """Canonical text of every column: fixed-width UTC times, trimmed decimals."""
    value = F.regexp_replace(F.col("value").cast("string"), r"(\.\d*?)0+$", "$1")
    times = [
        F.date_format(F.col(n), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(n) for n in TIMES
    ]
    return outcomes.select(
        *KEY,
        F.regexp_replace(value, r"\.$", "").alias("value"),
        *times,
        *[J.canonical(F.col(n)).alias(n) for n in PAYLOADS],
    )


def row_digest(columns: list[str] | None = None) -> Column:
    """SHA-256 over all columns of a canonical row; nulls are kept apart from text."""
    names = columns or OUTCOME_COLUMNS
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


@dataclass(frozen=True)
class AppendResult:
    inserted: int
    duplicates: int


def append_plan(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """One row per key of the batch: how often it occurs, and whether it conflicts,
    is already stored, or is new (``state``). The batch is reduced to keys and
    digests first. The stored table is scanned, but rows with other keys go before they
    are digested; adaptive execution picks that join by the measured size of the keys."""
    per_key = (
        batch.select(*KEY, row_digest().alias("digest"))
        .groupBy(*KEY)
        .agg(
            F.count("*").alias("copies"),
            F.min("digest").alias("digest"),
            F.max("digest").alias("other"),
        )
    )
    if stored is None:
        per_key = per_key.withColumn("held", F.lit(None).cast("string"))
    else:
        held = stored.join(per_key.select(*KEY), KEY, "left_semi").select(*KEY, row_digest().alias("held"))
        per_key = per_key.join(held, KEY, "left")
    conflict = (F.col("digest") != F.col("other")) | (F.col("held") != F.col("digest"))
    return per_key.select(
        *KEY,
        "copies",
        F.when(F.coalesce(conflict, F.lit(False)), "conflict")
        .when(F.col("held").isNotNull(), "stored")
        .otherwise("new")
        .alias("state"),
    )


def append_outcomes(batch: DataFrame, path: str) -> AppendResult:
    """Append canonical outcomes to a Parquet table; replays are counted, not stored.

    A key that already holds other contents, in the table or in the batch, aborts
    the append before anything is written. One writer at a time.
    """
    spark = batch.sparkSession
    batch = batch.select(*OUTCOME_COLUMNS)
    stored = spark.read.parquet(path).select(*OUTCOME_COLUMNS) if _exists(spark, path) else None
    plan = append_plan(batch, stored)
    totals = plan.agg(
        F.sum("copies").alias("rows"),
        F.count_if(F.col("state") == "new").alias("inserted"),
        F.count_if(F.col("state") == "conflict").alias("conflicts"),
    ).first()
    if totals.conflicts:
        raise OutcomeConflict("A conflicting record exists for a series and outcome id.")
    inserted = int(totals.inserted or 0)
    if inserted:
        new = plan.where(F.col("state") == "new").select(*KEY)
        fresh = batch if stored is None else batch.join(new, KEY, "left_semi")
        fresh = fresh.dropDuplicates(KEY).withColumn("ingested_at", F.current_timestamp())
        fresh.write.mode("append").parquet(path)
    return AppendResult(inserted, int(totals.rows or 0) - inserted)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def select_outcomes(
    outcomes: DataFrame,
    series: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
) -> DataFrame:
    """Outcomes of one series in the half-open interval [start, end)."""
    if series is not None:
        outcomes = outcomes.where(F.col("series") == series)
    if start is not None:
        outcomes = outcomes.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        outcomes = outcomes.where(F.col("ts") < F.lit(end).cast("timestamp"))
    return outcomes


def get_outcome(outcomes: DataFrame, series: str, outcome_id: str) -> DataFrame:
    return outcomes.where((F.col("series") == series) & (F.col("outcome_id") == outcome_id))


def count_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("series").agg(F.count("*").alias("outcomes"))


def list_outcomes(outcomes: DataFrame, limit: int = 100, offset: int = 0, **selection) -> DataFrame:
    """One page, oldest first. For deep pages use ``list_after`` instead of an offset."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("limit must be between 1 and 10000 and offset nonnegative.")
    page = select_outcomes(outcomes, **selection).orderBy(*ORDER)
    return page.offset(offset).limit(limit) if offset else page.limit(limit)


def list_after(outcomes: DataFrame, last: tuple, limit: int = 100, **selection) -> DataFrame:
    """The page that follows the row with order key ``last`` = (ts, series, outcome_id)."""
    ts, series, outcome_id = F.lit(last[0]).cast("timestamp"), F.lit(last[1]), F.lit(last[2])
    later = (F.col("ts") > ts) | (
        (F.col("ts") == ts)
        & (
            (F.col("series") > series)
            | ((F.col("series") == series) & (F.col("outcome_id") > outcome_id))
        )
    )
    return select_outcomes(outcomes, **selection).where(later).orderBy(*ORDER).limit(limit)


def distinct_series(outcomes: DataFrame, limit: int = 1000) -> DataFrame:
    """The first ``limit`` series names; ``truncated`` tells whether there are more."""
    names = outcomes.select("series").distinct()
    total = names.agg(F.count("*").alias("total"))
    return (
        names.orderBy("series")
        .limit(limit)
        .crossJoin(F.broadcast(total))
        .select("series", (F.col("total") > limit).alias("truncated"))
    )


def verify_table(stored_text: DataFrame) -> DataFrame:
    """Rows of a stored text table that are invalid or not in canonical form.

    An intact table gives no rows. Input columns are the raw outcome columns.
    """
    checked = check_outcomes(stored_text)
    number = F.regexp_replace(_stored_value("value").cast("string"), r"(\.\d*?)0+$", "$1")
    canonical = {"value": F.regexp_replace(number, r"\.$", "")}
    for name in KEY:
        canonical[name] = F.trim(F.col(name))
    for name in TIMES:
        canonical[name] = F.date_format(_instant(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    for name in PAYLOADS:
        canonical[name] = J.canonical(F.col(name))
    changed = F.array_compact(
        F.array(*[F.when(~F.col(n).eqNullSafe(e), F.lit(n)) for n, e in canonical.items()])
    )
    return (
        checked.withColumn("not_canonical", changed)
        .where((F.size("errors") > 0) | (F.size("not_canonical") > 0))
        .select(*KEY, "errors", "not_canonical")
    )


def export_outcomes(outcomes: DataFrame, path: str, **selection) -> DataFrame:
    """Write a selection as JSON lines in key order and return its manifest.

    Files are ranges of the order key, so their names sort like their rows. The
    target must not exist, and readers see files only after the job has committed.
    The manifest has one row per file: rows, bytes and the SHA-256 of its contents.
    """
    chosen = text_form(select_outcomes(outcomes, **selection))
    renamed = chosen.select(*[F.col(name).alias(key) for key, name in DOCUMENT_KEYS.items()])
    ordered = renamed.repartitionByRange("timestamp", "source", "round_id")
    ordered = ordered.sortWithinPartitions("timestamp", "source", "round_id")
    ordered.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    spark = outcomes.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path)
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("file"))
    digests = files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )
    return digests.join(lines.agg(F.count("*").alias("rows")), "file").select(
        "file", "rows", "bytes", "sha256"
    )


#: Digests that one digest is made of, at most.
FAN_IN = 4096


def dataset_fingerprint(outcomes: DataFrame, chunk_rows: int = 100_000, fan_in: int = FAN_IN) -> DataFrame:
    """Digest of the ordered values of each series.

    Rows are digested in chunks of consecutive positions, then the ordered digests of
    ``fan_in`` chunks, and those of a series, unless there is one only: no text is longer than
    ``fan_in`` digests up to ``chunk_rows * fan_in ** 2`` rows of a series. The figure
    differs from a digest over one joined list, except for the property that
    matters: equal sequences, equal digest.
    """
    from tidemark.plans.ordering import number

    shown = F.col("value").cast("string")
    # Zeros go only behind a point: 1, 10 and 100 are different values.
    text = F.when(shown.contains("."), F.regexp_replace(shown, r"\.?0+$", "")).otherwise(shown)
    numbered = number(
        outcomes.select("series", "ts", "outcome_id", text.alias("text")),
        ["series"],
        ["ts", "outcome_id"],
    )
    chunks = (
        numbered.groupBy("series", F.floor(F.col("pos") / F.lit(chunk_rows)).alias("chunk"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
        .select(
            "series",
            "chunk",
            F.size("rows").alias("n"),
            F.sha2(F.array_join(F.col("rows.text"), ","), 256).alias("digest"),
        )
    )
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "digest")))["digest"]
    groups = chunks.groupBy("series", F.floor(F.col("chunk") / F.lit(fan_in)).alias("up")).agg(
        F.sum("n").alias("n"), F.sha2(F.array_join(ordered, ","), 256).alias("digest")
    ).withColumnRenamed("up", "chunk")
    one = F.when(F.count("*") == 1, F.max("digest")).otherwise(F.sha2(F.array_join(ordered, ","), 256))
    return groups.groupBy("series").agg(F.sum("n").alias("outcomes"), one.alias("fingerprint"))


def strip_outcome_records(insertions: DataFrame) -> DataFrame:
    """Outcomes from strip insertions, with an id that depends only on what was seen."""
    from tidemark.sources.times import utc_text

    shown = F.coalesce(F.col("observed_text"), utc_text("ts")) if (
        "observed_text" in insertions.columns
    ) else utc_text("ts")
    details = F.to_json(
        F.struct(
            "edge",
            "history_size",
            F.lit("strip_shift").alias("observation_method"),
            "overlap",
            F.lit("first_observed_insertion").alias("timestamp_semantics"),
            "y_bucket",
        )
    )
    number = F.expr(f"try_cast(value as {STORED_VALUE_TYPE})")
    nothing = F.lit(None).cast("timestamp")
    return insertions.select(
        "series",
        C.token_id("strip-", shown, F.col("value"), F.col("edge"), F.col("y_bucket").cast("string")).alias(
            "outcome_id"
        ),
        number.alias("value"),
        "ts",
        F.col("ts").alias("collection_ts"),
        nothing.alias("started_at"),
        nothing.alias("pre_observed_at"),
        F.lit("{}").alias("pre_data"),
        details.alias("post_data"),
        F.lit("{}").alias("raw_data"),
    ).where(F.col("value").isNotNull())
