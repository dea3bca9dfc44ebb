"""Ingestion, storage queries, sanitising and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import documents as J
from tidemark.operators import describe, sanitize
from tidemark.registry.common import OUTCOMES
from tidemark.sources import driver_tables as D
from tidemark.sources import outcomes as S

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# --- ingestion ---------------------------------------------------------------------------


def _raw(spark, sf_dir):
    """All events as text records; several kinds of them break a rule."""
    event_id = F.col("event_id")
    zone = F.when(event_id % 11 == 0, "").when(event_id % 2 == 0, "Z").otherwise("+00:00")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    early = F.timestamp_micros(F.unix_micros("ts") - 60_000_000)
    return D.events(spark, sf_dir).select(
        F.concat(F.lit(" "), "event_type").alias("series"),
        F.when(event_id % 13 == 0, " ").otherwise(event_id.cast("string")).alias("outcome_id"),
        F.when(event_id % 17 == 0, "abc").otherwise(
            F.col("value").cast("decimal(18,4)").cast("string")
        ).alias("value"),
        F.concat(text, zone).alias("ts"),
        F.concat(
            F.when(event_id % 19 == 0, F.date_format(early, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(text),
            F.lit("Z"),
        ).alias("collection_ts"),
        F.lit(None).cast("string").alias("started_at"),
        F.lit(None).cast("string").alias("pre_observed_at"),
        F.when(event_id % 23 == 0, '{"a":1}').otherwise("{}").alias("pre_data"),
        F.when(event_id % 29 == 0, '{"x":{"Access-Token":"t"}}').when(event_id % 31 == 0, '{"a":1,"a":2}')
        .otherwise(F.col("props")).alias("post_data"),
        F.when(event_id % 37 == 0, "[1]").otherwise("{}").alias("raw_data"),
    )


RAW_RULES = """
raw AS (
  SELECT *, CAST(value AS DECIMAL(18,4)) AS shown FROM events),
broken AS (
  SELECT event_id, unnest(list_filter([
    CASE WHEN event_id % 13 = 0 THEN 'OUTCOME_ID_EMPTY' END,
    CASE WHEN event_id % 11 = 0 THEN 'TS_INVALID' END,
    CASE WHEN event_id % 17 = 0 THEN 'VALUE_INVALID' END,
    CASE WHEN event_id % 17 <> 0 AND shown < 1 THEN 'VALUE_BELOW_ONE' END,
    CASE WHEN event_id % 23 = 0 THEN 'PRE_DATA_WITHOUT_TIME' END,
    CASE WHEN event_id % 29 = 0 THEN 'POST_DATA_AUTH_KEY' END,
    CASE WHEN event_id % 31 = 0 AND event_id % 29 <> 0 THEN 'POST_DATA_DUPLICATE_KEY' END,
    CASE WHEN event_id % 37 = 0 THEN 'RAW_DATA_NOT_OBJECT' END,
    CASE WHEN event_id % 19 = 0 AND event_id % 11 <> 0 THEN 'COLLECTION_BEFORE_RESULT' END
  ], lambda x: x IS NOT NULL)) AS code FROM raw)"""


@query(
    "validate_outcomes",
    f"WITH {RAW_RULES} SELECT code, count(*) AS records FROM broken GROUP BY code",
)
def _(spark, sf_dir):
    _, quarantine = S.validate_outcomes(_raw(spark, sf_dir))
    codes = quarantine.select(F.explode("errors").alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("records"))


@query(
    "canonicalise_outcomes",
    f"""WITH {RAW_RULES}
    SELECT event_type AS series, CAST(event_id AS VARCHAR) AS outcome_id,
      regexp_replace(regexp_replace(CAST(shown AS VARCHAR), '0+$', ''), '\\.$', '') AS value,
      strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS ts,
      '{{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}}' AS post_data
    FROM raw WHERE event_id NOT IN (SELECT event_id FROM broken)""",
)
def _(spark, sf_dir):
    good, _ = S.validate_outcomes(_raw(spark, sf_dir))
    return S.text_form(good).select("series", "outcome_id", "value", "ts", "post_data")


@query(
    "unique_key_check_all",
    """SELECT event_id % 31 <> 0 OR event_id % 29 = 0 AS unique_keys, count(*) AS records FROM events GROUP BY 1""",
)
def _(spark, sf_dir):
    return _raw(spark, sf_dir).groupBy(J.has_unique_keys(F.col("post_data")).alias("unique_keys")).agg(
        F.count("*").alias("records")
    )


@query(
    "append_outcomes",
    f"""WITH {OUTCOMES},
    stored AS (SELECT outcome_id, event_id % 10 = 0 AS other FROM outcomes WHERE event_id % 2 = 0)
    SELECT o.series, CASE WHEN s.other THEN 'conflict' WHEN s.outcome_id IS NOT NULL THEN 'stored'
             ELSE 'new' END AS state, count(*) AS keys, CAST(sum(2) AS BIGINT) AS copies
    FROM outcomes o LEFT JOIN stored s USING (outcome_id) GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = D.outcomes(spark, sf_dir).select(*S.OUTCOME_COLUMNS)
    number = F.col("outcome_id").cast("bigint")
    held = rows.where(number % 2 == 0).withColumn(
        "value", F.when(number % 10 == 0, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(18,6)")
    )
    plan = S.append_plan(rows.unionByName(rows), held)
    return plan.groupBy("series", "state").agg(
        F.count("*").alias("keys"), F.sum("copies").alias("copies")
    )


@query(
    "get_outcome",
    f"WITH {OUTCOMES} SELECT series, outcome_id, value::DOUBLE AS value, ts FROM outcomes WHERE series = 'click' AND outcome_id = '1'",
)
def _(spark, sf_dir):
    return S.get_outcome(D.outcomes(spark, sf_dir), "click", "1").select("series", "outcome_id", "value", "ts")


@query("count_outcomes", f"WITH {OUTCOMES} SELECT series, count(*) AS outcomes FROM outcomes GROUP BY series")
def _(spark, sf_dir):
    return S.count_outcomes(D.outcomes(spark, sf_dir))


PAGE_SQL = f"""WITH {OUTCOMES} SELECT series, outcome_id, value::DOUBLE AS value, ts FROM outcomes
    WHERE series = 'view' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20'
    ORDER BY ts, series, outcome_id LIMIT 100 OFFSET 20"""


@query("list_outcomes", PAGE_SQL)
def _(spark, sf_dir):
    page = S.list_outcomes(
        D.outcomes(spark, sf_dir), 100, 20, series="view", start="2024-01-02", end="2024-01-20"
    )
    return page.select("series", "outcome_id", "value", "ts")


@query(
    "list_outcomes_keyset",
    f"""WITH {OUTCOMES} SELECT series, outcome_id, ts FROM outcomes
    WHERE (ts, series, outcome_id) > (TIMESTAMP '2024-01-10', 'error', '5')
    ORDER BY ts, series, outcome_id LIMIT 50""",
)
def _(spark, sf_dir):
    page = S.list_after(D.outcomes(spark, sf_dir), ("2024-01-10", "error", "5"), 50)
    return page.select("series", "outcome_id", "ts")


@query(
    "distinct_series",
    "SELECT CAST(user_id AS VARCHAR) AS series, (SELECT count(DISTINCT user_id) FROM events) > 40 AS truncated FROM events GROUP BY user_id ORDER BY series LIMIT 40",
)
def _(spark, sf_dir):
    rows = D.events(spark, sf_dir).select(F.col("user_id").cast("string").alias("series"))
    return S.distinct_series(rows, 40)


@query(
    "verify_table",
    """SELECT event_type AS series, CAST(event_id AS VARCHAR) AS outcome_id,
      CASE WHEN event_id % 2 = 0 THEN 'value' ELSE 'pre_data' END AS changed
    FROM events WHERE value >= 1 AND event_id % 5 = 0""",
)
def _(spark, sf_dir):
    stored = S.text_form(D.outcomes(spark, sf_dir))
    number = F.col("outcome_id").cast("bigint")
    damaged = stored.withColumns(
        {
            "value": F.when(number % 10 == 0, F.concat(F.col("value").cast("decimal(18,6)").cast("string"), F.lit("0"))).otherwise(F.col("value")),
            "pre_data": F.when(number % 10 == 5, F.concat(F.lit(" "), F.col("pre_data"))).otherwise(F.col("pre_data")),
        }
    )
    found = S.verify_table(damaged)
    return found.select("series", "outcome_id", F.array_join("not_canonical", ",").alias("changed"))


@query(
    "dataset_fingerprint",
    f"""WITH {OUTCOMES}, placed AS (
      SELECT series, row_number() OVER (PARTITION BY series ORDER BY ts, outcome_id) - 1 AS pos,
             regexp_replace(CAST(value AS VARCHAR), '\\.?0+$', '') AS text FROM outcomes),
    chunks AS (SELECT series, pos // 500 AS chunk, count(*) AS n, sha256(string_agg(text, ',' ORDER BY pos)) AS digest
               FROM placed GROUP BY ALL)
    SELECT series, CAST(sum(n) AS BIGINT) AS outcomes, sha256(string_agg(digest, ',' ORDER BY chunk)) AS fingerprint
    FROM chunks GROUP BY series""",
)
def _(spark, sf_dir):
    return S.dataset_fingerprint(D.outcomes(spark, sf_dir), 500)


# --- sanitising ----------------------------------------------------------------------------


@query(
    "strip_url",
    "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages",
)
def _(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", sanitize.strip_url(F.col("url")).alias("url"))


@query(
    "json_path_inventory",
    """WITH n AS (SELECT event_type AS series, count(*) AS n FROM events GROUP BY 1),
    p(path, type) AS (VALUES ('type','string'), ('data','object'), ('data.multiplier','string'),
      ('data.round-id','number'), ('data.items','array'), ('data.items[]','object'),
      ('data.items[].k','number'), ('user','number'))
    SELECT series, path, type, n AS documents, n AS parsed_documents, 1.0::DOUBLE AS coverage FROM n, p""",
)
def _(spark, sf_dir):
    return sanitize.json_path_inventory(D.documents_json(spark, sf_dir))


@query(
    "extract_numeric_fields",
    "SELECT event_id AS doc_id, 'data.multiplier' AS path, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events",
)
def _(spark, sf_dir):
    return sanitize.extract_numeric_fields(D.documents_json(spark, sf_dir)).select("doc_id", "path", "value")


@query(
    "hash_identifiers",
    """SELECT event_id AS doc_id, 'data.roundid' AS path, substr(sha256(CAST(event_id AS VARCHAR)), 1, 24) AS sha256_24,
    length(CAST(event_id AS VARCHAR)) AS length FROM events""",
)
def _(spark, sf_dir):
    return sanitize.hash_identifiers(D.documents_json(spark, sf_dir)).select("doc_id", "path", "sha256_24", "length")


@query("extract_categories", "SELECT event_id AS doc_id, 'type' AS path, event_type AS value FROM events")
def _(spark, sf_dir):
    return sanitize.extract_categories(D.documents_json(spark, sf_dir)).select("doc_id", "path", "value")


@query("reject_auth_keys", "SELECT event_id AS doc_id FROM events")
def _(spark, sf_dir):
    return sanitize.reject_auth_keys(D.documents_json(spark, sf_dir)).select("doc_id")


SHAPES = """n AS (SELECT event_type AS series, event_id % 6 AS shape, count(*) AS n FROM events GROUP BY ALL),
    whole AS (SELECT series, CAST(sum(n) AS BIGINT) AS parsed_documents FROM n WHERE shape <> 4 GROUP BY series)"""


@query(
    "json_path_inventory_shapes",
    f"""WITH {SHAPES}, p(shape, path, type) AS (
      SELECT * FROM (VALUES (0, 'k', 'number'), (1, 'a', 'array'), (1, 'a[]', 'object'), (1, 'a[].b', 'number'), (1, 'a[].c', 'string'), (1, 'a[]', 'number'),
        (1, 'a[]', 'array'), (1, 'a[][]', 'boolean'), (3, '[]', 'object'), (3, '[].z', 'null'), (3, '[].state', 'string'), (5, 'user', 'object'), (5, 'note', 'string'))
      UNION ALL SELECT 2, rtrim(repeat('d.', i), '.'), 'object' FROM range(1, 21) AS r(i) UNION ALL SELECT 2, repeat('d.', 20) || 'multiplier', 'string'),
    c AS (SELECT series, path, type, CAST(sum(n) AS BIGINT) AS documents FROM n JOIN p USING (shape) GROUP BY ALL)
    SELECT c.*, parsed_documents, round_even(documents / parsed_documents, 6) AS coverage FROM c JOIN whole USING (series)""",
)
def _(spark, sf_dir):
    return sanitize.json_path_inventory(D.documents_of_shapes(spark, sf_dir))


@query("extract_numeric_fields_shapes", "SELECT event_id AS doc_id, repeat('d.', 20) || 'multiplier' AS path, 2.5::DOUBLE AS value FROM events WHERE event_id % 6 = 2")
def _(spark, sf_dir):
    return sanitize.extract_numeric_fields(D.documents_of_shapes(spark, sf_dir)).select("doc_id", "path", "value")


@query("extract_categories_shapes", "SELECT event_id AS doc_id, '[].state' AS path, 'open' AS value FROM events WHERE event_id % 6 = 3")
def _(spark, sf_dir):
    return sanitize.extract_categories(D.documents_of_shapes(spark, sf_dir)).select("doc_id", "path", "value")


@query("reject_auth_keys_shapes", "SELECT event_id AS doc_id FROM events WHERE event_id % 6 = 5")
def _(spark, sf_dir):
    return sanitize.reject_auth_keys(D.documents_of_shapes(spark, sf_dir)).select("doc_id")


@query(
    "payload_formats_shapes",
    """WITH t AS (SELECT CASE event_id % 6 WHEN 3 THEN 'array' WHEN 4 THEN NULL ELSE 'object' END AS root_type, CASE event_id % 6 WHEN 4 THEN 'text' ELSE 'json' END AS format,
      [7, 34, 141, 44, 5, 47][event_id % 6 + 1] AS bytes FROM events)
    SELECT format, root_type, count(*) AS payloads, CAST(sum(bytes) AS BIGINT) AS total_bytes FROM t GROUP BY ALL""",
)
def _(spark, sf_dir):
    return sanitize.payload_formats(D.documents_of_shapes(spark, sf_dir), "text")


@query(
    "payload_digest",
    """SELECT conv_id, turn, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256,
    'text' AS format FROM conversations""",
)
def _(spark, sf_dir):
    rows = sanitize.payload_digest(D.table(spark, sf_dir, "conversations"), "text")
    return rows.select("conv_id", "turn", "bytes", "sha256", "format")


@query(
    "payload_formats",
    """SELECT 'json' AS format, 'object' AS root_type, count(*) AS payloads,
    CAST(sum(octet_length(encode(props))) AS BIGINT) AS total_bytes FROM events""",
)
def _(spark, sf_dir):
    return sanitize.payload_formats(D.events(spark, sf_dir), "props")


@query(
    "repeated_payloads",
    """SELECT sha256(text) AS sha256, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS bytes, count(*) AS copies
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(spark, sf_dir):
    return sanitize.repeated_payloads(D.table(spark, sf_dir, "documents"), "text")


def _byte_sql(source: str, key: str) -> str:
    return f"""WITH hexes AS (SELECT {key} AS id, hex(encode(text)) AS h FROM {source}),
    bytes AS (SELECT id, unnest(regexp_extract_all(h, '..')) AS b FROM hexes),
    counts AS (SELECT id, CAST('0x' || b AS INTEGER) AS byte, count(*) AS n FROM bytes GROUP BY ALL),
    sums AS (SELECT id, sum(n) AS total FROM counts GROUP BY id),
    stats AS (SELECT c.id, any_value(total) AS len, sum(-(n / total) * log2(n / total)) AS entropy,
        sum(CASE WHEN byte BETWEEN 32 AND 126 THEN n ELSE 0 END) AS printable,
        sum(CASE WHEN byte = 0 THEN n ELSE 0 END) AS zero,
        sum(CASE WHEN byte >= 128 THEN n ELSE 0 END) AS high, count(*) AS uniq
      FROM counts c JOIN sums USING (id) GROUP BY c.id)
    SELECT id AS {key}, CAST(len AS BIGINT) AS bytes,
      round_even(round_even(entropy / 0.25, 0) * 0.25, 2) AS entropy_bucket,
      round_even(round_even(printable / len / 0.05, 0) * 0.05, 2) AS printable_ratio_bucket,
      round_even(round_even(zero / len / 0.05, 0) * 0.05, 2) AS zero_ratio_bucket,
      round_even(round_even(high / len / 0.05, 0) * 0.05, 2) AS high_bit_ratio_bucket,
      CAST(least(256, ((uniq + 7) // 8) * 8) AS INTEGER) AS unique_byte_bucket FROM stats"""


@query("byte_profile", _byte_sql("documents", "doc_id"))
def _(spark, sf_dir):
    return sanitize.byte_profile(D.table(spark, sf_dir, "documents"), "text", "doc_id")


@query("byte_profile_by_group", _byte_sql("documents", "lang"))
def _(spark, sf_dir):
    return sanitize.byte_profile_by(D.table(spark, sf_dir, "documents"), "text", ["lang"])


# --- description ---------------------------------------------------------------------------


def _median(name: str) -> str:
    """The mean of the two middle values, in their own type, not in doubles."""
    ordered = f"list_sort(list({name}))"
    return f"(({ordered}[(count(*) + 1) // 2] + {ordered}[count(*) // 2 + 1]) * 0.5)::DOUBLE"


@query(
    "numeric_summary",
    f"""WITH {OUTCOMES} SELECT series, count(*) AS n, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max,
    round_even(sum(value)::DOUBLE / count(*), 6) AS mean, {_median('value')} AS median
    FROM outcomes GROUP BY series""",
)
def _(spark, sf_dir):
    return describe.numeric_summary(D.outcomes(spark, sf_dir), "value", ["series"])


@query(
    "bucket_histogram",
    f"""WITH {OUTCOMES}, b(lower, upper) AS (VALUES (1.0, 2.0), (2.0, 5.0), (5.0, 10.0), (10.0, NULL)),
    s AS (SELECT series, count(*) AS n FROM outcomes GROUP BY series)
    SELECT s.series, lower::DOUBLE AS lower, upper::DOUBLE AS upper, count(o.value) AS count,
      round_even(count(o.value) * 100 / any_value(n), 2) AS pct
    FROM s CROSS JOIN b LEFT JOIN outcomes o ON o.series = s.series AND o.value >= lower AND (upper IS NULL OR o.value < upper)
    GROUP BY ALL""",
)
def _(spark, sf_dir):
    return describe.bucket_histogram(D.outcomes(spark, sf_dir), ["series"])


@query(
    "metadata_coverage",
    f"""WITH {OUTCOMES} SELECT series, count(*) AS outcomes, count(started_at) AS with_started_at,
    count(pre_observed_at) AS with_pre_observed_at, count(*) FILTER (pre_data <> '{{}}') AS with_pre_data,
    count(*) AS with_post_data, CAST(0 AS BIGINT) AS with_raw_data FROM outcomes GROUP BY series""",
)
def _(spark, sf_dir):
    return describe.metadata_coverage(D.outcomes(spark, sf_dir), ["series"])


@query(
    "repeated_timestamps",
    """SELECT o_orderpriority AS series, count(*) - count(DISTINCT o_orderdate) AS repeated_timestamps
    FROM orders GROUP BY 1""",
)
def _(spark, sf_dir):
    return describe.repeated_timestamps(D.order_outcomes(spark, sf_dir), by_series=True)


@query(
    "collection_delay",
    f"""WITH {OUTCOMES}, d AS (SELECT series, (epoch_us(collection_ts) - epoch_us(ts)) / 1e6 AS d FROM outcomes)
    SELECT series, count(*) AS n, min(d) AS min, max(d) AS max, round_even(avg(d), 6) AS mean,
    {_median('d')} AS median FROM d GROUP BY series""",
)
def _(spark, sf_dir):
    return describe.collection_delay(D.outcomes(spark, sf_dir), ["series"])


@query(
    "range_and_series_count",
    f"""WITH {OUTCOMES} SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-05') AS selected,
    count(DISTINCT series) FILTER (ts >= TIMESTAMP '2024-01-05') AS series_count,
    min(ts) FILTER (ts >= TIMESTAMP '2024-01-05') AS first_ts, max(ts) AS last_ts, count(*) AS stored,
    'COMPLETE' AS status FROM outcomes""",
)
def _(spark, sf_dir):
    rows = D.outcomes(spark, sf_dir)
    return describe.range_and_series_count(S.select_outcomes(rows, start="2024-01-05"), rows)


@query(
    "outcome_report",
    f"""WITH {OUTCOMES}, r AS (SELECT *, (epoch_us(collection_ts) - epoch_us(ts)) / 1e6 AS d FROM outcomes)
    SELECT series, count(*) AS selected, count(DISTINCT series) AS series_count, min(ts) AS first_ts, max(ts) AS last_ts,
      min(value)::DOUBLE AS value_min, max(value)::DOUBLE AS value_max,
      round_even(sum(value)::DOUBLE / count(*), 6) AS value_mean, {_median('value')} AS value_median,
      min(d) AS delay_min, max(d) AS delay_max, round_even(avg(d), 6) AS delay_mean, {_median('d')} AS delay_median,
      count(*) FILTER (value < 2) AS bucket_0, count(*) FILTER (value >= 2 AND value < 5) AS bucket_1,
      count(*) FILTER (value >= 5 AND value < 10) AS bucket_2, count(*) FILTER (value >= 10) AS bucket_3,
      round_even(100 * count(*) FILTER (value < 2) / count(*), 2) AS bucket_0_pct,
      round_even(100 * count(*) FILTER (value >= 2 AND value < 5) / count(*), 2) AS bucket_1_pct,
      round_even(100 * count(*) FILTER (value >= 5 AND value < 10) / count(*), 2) AS bucket_2_pct,
      round_even(100 * count(*) FILTER (value >= 10) / count(*), 2) AS bucket_3_pct,
      count(started_at) AS with_started_at, count(pre_observed_at) AS with_pre_observed_at,
      count(*) FILTER (pre_data <> '{{}}') AS with_pre_data, count(*) AS with_post_data,
      CAST(0 AS BIGINT) AS with_raw_data,
      count(*) - count(DISTINCT (series, ts)) AS repeated_timestamps, 'COMPLETE' AS status
    FROM r GROUP BY GROUPING SETS ((), (series))""",
)
def _(spark, sf_dir):
    return describe.outcome_report(D.outcomes(spark, sf_dir))
