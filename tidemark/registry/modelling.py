"""Forecasts and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import evaluate, features, forecast, ledger, logistic, online, ridge
from tidemark.plans.lineage import settle
from tidemark.registry.common import FREQUENCY, OUTCOMES, THRESHOLD_ROWS, users
from tidemark.registry.timing import _fired
from tidemark.sources import driver_tables as D

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


# --- frequency ---------------------------------------------------------------------------


@query(
    "frequency_forecast",
    f"""WITH {FREQUENCY} SELECT series, outcome_id, threshold::DOUBLE AS threshold, n AS sample_count, CAST(hits AS BIGINT) AS hits,
    probability, CASE WHEN n >= 50 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM forecast""",
)
def _(spark, sf_dir):
    rows = forecast.frequency_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS)
    return rows.select("series", "outcome_id", "threshold", "sample_count", "hits", "probability", "status")


ROLLING = f"""{OUTCOMES}, {THRESHOLD_ROWS}, forecast AS (
  SELECT *, CASE WHEN n >= 50 THEN round_even(hits / n, 6) END AS probability FROM (
    SELECT o.series, o.outcome_id, th.threshold, count(*) OVER w AS n,
      coalesce(sum(CASE WHEN o.value >= th.threshold THEN 1 ELSE 0 END) OVER w, 0) AS hits,
      CASE WHEN o.value >= th.threshold THEN 1 ELSE 0 END AS actual
    FROM outcomes o, th WINDOW w AS (PARTITION BY o.series, th.threshold ORDER BY o.ts, o.outcome_id ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)))"""


@query(
    "frequency_forecast_rolling",
    f"""WITH {ROLLING} SELECT series, outcome_id, threshold::DOUBLE AS threshold, n AS sample_count, CAST(hits AS BIGINT) AS hits, probability FROM forecast""",
)
def _(spark, sf_dir):
    rows = forecast.frequency_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS, "rolling", 120)
    return rows.select("series", "outcome_id", "threshold", "sample_count", "hits", "probability")


def _brier_sql(cte: str) -> str:
    return f"""WITH {cte} SELECT series, threshold::DOUBLE AS threshold, count(probability) AS predictions,
    CAST(coalesce(sum(actual) FILTER (probability IS NOT NULL), 0) AS BIGINT) AS positives,
    round_even(avg((probability - actual) * (probability - actual)), 6) AS brier_score,
    round_even(abs(avg(probability) - avg(actual) FILTER (probability IS NOT NULL)), 6) AS calibration_error,
    count(*) - count(probability) AS skipped FROM forecast GROUP BY series, threshold"""


@query("walk_forward_frequency", _brier_sql(FREQUENCY))
def _(spark, sf_dir):
    return evaluate.walk_forward_frequency(D.outcomes(spark, sf_dir), D.THRESHOLDS)


@query("walk_forward_frequency_rolling", _brier_sql(ROLLING))
def _(spark, sf_dir):
    return evaluate.walk_forward_frequency(D.outcomes(spark, sf_dir), D.THRESHOLDS, "rolling", 120)


@query(
    "walk_forward_frequency_orders",
    """WITH th(threshold) AS (VALUES (50000.0), (150000.0), (300000.0)),
    outcomes AS (SELECT o_orderpriority AS series, CAST(o_orderkey AS VARCHAR) AS outcome_id, CAST(o_totalprice AS DECIMAL(18,6)) AS value, o_orderdate AS ts FROM orders),
    forecast AS (SELECT *, CASE WHEN n >= 100 THEN round_even(hits / n, 6) END AS probability FROM (
      SELECT o.series, th.threshold, count(*) OVER w AS n, coalesce(sum(CASE WHEN value >= threshold THEN 1 ELSE 0 END) OVER w, 0) AS hits,
        CASE WHEN value >= threshold THEN 1 ELSE 0 END AS actual FROM outcomes o, th
      WINDOW w AS (PARTITION BY o.series, th.threshold ORDER BY o.ts, o.outcome_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    SELECT series, threshold::DOUBLE AS threshold, count(probability) AS predictions,
    CAST(coalesce(sum(actual) FILTER (probability IS NOT NULL), 0) AS BIGINT) AS positives,
    round_even(avg((probability - actual) * (probability - actual)), 6) AS brier_score,
    round_even(abs(avg(probability) - avg(actual) FILTER (probability IS NOT NULL)), 6) AS calibration_error,
    count(*) - count(probability) AS skipped FROM forecast GROUP BY series, threshold""",
)
def _(spark, sf_dir):
    rows = D.order_outcomes(spark, sf_dir)
    return evaluate.walk_forward_frequency(rows, ("50000", "150000", "300000"), min_history=100)


@query(
    "prior_forecast",
    f"""WITH {FREQUENCY} SELECT series, outcome_id AS previous_id, ts AS previous_ts, n + 1 AS historical_outcomes, threshold::DOUBLE AS threshold,
    round_even((hits + actual) / (n + 1), 6) AS probability FROM forecast""",
)
def _(spark, sf_dir):
    return forecast.prior_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS)


# --- point and regression ------------------------------------------------------------------


@query("batched_ridge")
def _(spark, sf_dir):
    rows = features.regime_features(D.outcomes(spark, sf_dir))
    samples = rows.select(
        "series", "pos", F.array(*features.regime_names(5)).alias("x"), C.log_value("value").alias("y")
    )
    fitted = ridge.batched_ridge(samples, 1.0, 10)
    return fitted.select("series", "pos", F.bround("predicted", 6).alias("predicted"))


@query(
    "batched_ridge_of_one",
    f"""WITH {OUTCOMES}, l AS (SELECT series, ts, outcome_id, ln(least(value::DOUBLE, 1000.0)) AS y FROM outcomes),
    s AS (SELECT *, lag(y) OVER w AS x, row_number() OVER w - 2 AS pos FROM l WINDOW w AS (PARTITION BY series ORDER BY ts, outcome_id)),
    m AS (SELECT series, pos, x, count(*) OVER w AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my, sum(x * y) OVER w AS sxy, sum(x * x) OVER w AS sxx FROM s WHERE pos >= 0
      WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT series, pos, CASE WHEN n >= 10 THEN round_even(my + (sxy - n * mx * my) / ((sxx / n - mx * mx) * (n + 1.0)) * (x - mx), 6) END AS predicted FROM m""",
)
def _(spark, sf_dir):
    """A ridge on the logarithm before, which SQL can solve too."""
    rows = features.lag_log_features(D.outcomes(spark, sf_dir), 1, 1, warm_only=False).where("pos >= 1")
    samples = rows.select("series", (F.col("pos") - 1).alias("pos"), F.array("log_value_lag_1").alias("x"), C.log_value("value").alias("y"))
    fitted = ridge.batched_ridge(samples, 1.0, 10)
    return fitted.select("series", "pos", F.bround("predicted", 6).alias("predicted"))


@query("point_forecast")
def _(spark, sf_dir):
    rows = ridge.point_forecast(forecast.with_next(D.outcomes(spark, sf_dir)))
    return rows.select(
        "series", "pos", "status", "predicted", "lower", "upper", "confidence", "regime",
        "validation_rows", "validation_mae_log",
    )


@query("walk_forward_point")
def _(spark, sf_dir):
    return evaluate.walk_forward_point(D.outcomes(spark, sf_dir))


@query(
    "chronological_split",
    f"""WITH {OUTCOMES}, s AS (SELECT series, outcome_id, row_number() OVER (PARTITION BY series ORDER BY ts, outcome_id) - 1 AS pos FROM outcomes),
    w AS (SELECT *, pos - 20 AS rank, count(*) OVER (PARTITION BY series) AS n FROM s WHERE pos >= 20),
    e AS (SELECT *, n - greatest(1, floor(n * 0.2::DOUBLE)) AS test_start FROM w)
    SELECT series, CASE WHEN rank >= test_start THEN 'test' WHEN rank >= test_start - greatest(1, floor(n * 0.2::DOUBLE)) THEN 'validation' ELSE 'train' END AS part,
      count(*) AS rows, CAST(min(pos) AS BIGINT) AS first_pos FROM e GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = features.lag_log_features(D.outcomes(spark, sf_dir)).select("series", "outcome_id", "pos")
    split = logistic.chronological_split(rows)
    return split.groupBy("series", "part").agg(
        F.count("*").alias("rows"), F.min("pos").alias("first_pos")
    )


@query("logistic_experiment")
def _(spark, sf_dir):
    rows = logistic.logistic_experiment(D.outcomes(spark, sf_dir), D.THRESHOLDS)
    names = ["validation_brier", "test_brier", "baseline_test_brier", "test_positive_rate", "intercept"]
    rows = rows.withColumns({n: F.bround(n, 6) for n in names})
    return rows.withColumn("weights", F.transform("weights", lambda w: F.bround(w, 6)))


@query(
    "logistic_optimality",
    f"""WITH {FREQUENCY}, s AS (SELECT series, threshold, n - 20 AS rank, actual, round_even(hits / n, 6) AS base, count(*) OVER (PARTITION BY series, threshold) AS m FROM prefix WHERE n >= 20),
    cut AS (SELECT *, m - greatest(1, floor(m * 0.2::DOUBLE)) AS test_start, m - greatest(1, floor(m * 0.2::DOUBLE)) - greatest(1, floor(m * 0.2::DOUBLE)) AS validation_start FROM s),
    r AS (SELECT series, threshold, count(*) FILTER (rank < validation_start) AS train_rows, count(*) FILTER (rank >= validation_start AND rank < test_start) AS validation_rows,
      count(*) FILTER (rank >= test_start) AS test_rows, round_even(avg((base - actual) * (base - actual)) FILTER (rank >= test_start), 6) AS baseline,
      round_even(avg(actual) FILTER (rank >= test_start), 6) AS test_positive_rate,
      min(actual) FILTER (rank < validation_start) < max(actual) FILTER (rank < validation_start) AS varied FROM cut WHERE m >= 5 AND validation_start >= 1 GROUP BY series, threshold)
    SELECT series, threshold::DOUBLE AS threshold, CASE WHEN varied THEN 'COMPLETE' ELSE 'INSUFFICIENT_CLASS_VARIATION' END AS status, train_rows, validation_rows, test_rows,
      CASE WHEN varied THEN baseline END AS baseline_test_brier, test_positive_rate, CASE WHEN varied THEN true END AS optimal FROM r""",
)
def _(spark, sf_dir):
    """The gradient of the penalised loss at the published weights, summed anew over all rows."""
    outcomes = D.outcomes(spark, sf_dir)
    report = logistic.logistic_experiment(outcomes, D.THRESHOLDS)
    known = logistic.chronological_split(logistic.labelled_samples(outcomes, D.THRESHOLDS)).where("part <> 'test'")
    limits = F.array(*[F.lit(float(t)) for t in D.THRESHOLDS])
    rows = known.select("series", "x", F.posexplode("hits").alias("k", "y")).select("series", "x", "y", F.get(limits, "k").alias("threshold"))
    rows = rows.join(report.where("status = 'COMPLETE'").select("series", "threshold", "selected_c", "intercept", "weights"), ["series", "threshold"])
    margin = F.aggregate(F.zip_with("x", "weights", lambda x, w: x * w), F.col("intercept"), lambda a, b: a + b)
    rows = rows.withColumn("off", 1 / (1 + F.exp(-margin)) - F.col("y"))
    width = range(len(features.lag_names(5, features.RATE_THRESHOLDS)))
    sums = rows.groupBy("series", "threshold").agg(
        F.abs(F.sum("off")).alias("free"),
        *[F.abs(F.first("selected_c") * F.sum(F.get("x", F.lit(i)) * F.col("off")) + F.first(F.get("weights", F.lit(i))) * F.var_pop(F.get("x", F.lit(i)))).alias(f"g{i}") for i in width],
    )
    best = F.greatest("free", *[f"g{i}" for i in width]) < 1e-6
    found = report.join(sums.select("series", "threshold", best.alias("optimal")), ["series", "threshold"], "left")
    return found.select(
        "series", "threshold", "status", "train_rows", "validation_rows", "test_rows",
        F.bround("baseline_test_brier", 6).alias("baseline_test_brier"), F.bround("test_positive_rate", 6).alias("test_positive_rate"), "optimal",
    )


@query("gated_logistic_forecast")
def _(spark, sf_dir):
    return logistic.gated_logistic_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS)


# --- scored forecasts ----------------------------------------------------------------------


def _scored(spark, sf_dir):
    """Forecasts as scored rows: a trigger word, the prior, and the outcome unless open."""
    rows = forecast.frequency_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS).where("status = 'READY'")
    event_id = F.col("outcome_id").cast("bigint")
    return rows.select(
        "series", event_id.alias("seq"), "threshold",
        F.concat(F.lit("t"), (event_id % 50).cast("string")).alias("trigger_signature"),
        F.col("probability").alias("prior"),
        F.when(event_id % 97 != 0, F.col("actual")).alias("outcome"),
    )


SCORED = f"""{FREQUENCY}, scored AS (
  SELECT series, event_id AS seq, threshold, 't' || (event_id % 50) AS trigger_signature, probability AS prior,
    CASE WHEN event_id % 97 <> 0 THEN actual END AS outcome FROM forecast WHERE n >= 50),
counted AS (SELECT *, count(outcome) OVER a AS all_n, coalesce(sum(outcome) OVER a, 0) AS all_hits,
    count(outcome) OVER s AS same_n, coalesce(sum(outcome) OVER s, 0) AS same_hits FROM scored
  WINDOW a AS (PARTITION BY series, threshold ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    s AS (PARTITION BY series, threshold, trigger_signature ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
halves AS (SELECT *, CASE WHEN same_n >= 6 THEN 'same_trigger' ELSE 'global' END AS cohort_kind,
    CASE WHEN same_n >= 6 THEN same_n ELSE all_n END AS cohort_samples,
    CAST(round(prior * 1000000) AS BIGINT) * 20 + CASE WHEN same_n >= 6 THEN same_hits ELSE all_hits END * 1000000 AS num,
    20 + CASE WHEN same_n >= 6 THEN same_n ELSE all_n END AS den FROM counted),
cohort AS (SELECT * EXCLUDE (num, den), CAST((num // den + CASE WHEN 2 * (num % den) > den OR (2 * (num % den) = den AND (num // den) % 2 = 1)
    THEN 1 ELSE 0 END) / 1000000 AS DECIMAL(18,6)) AS candidate FROM halves)"""


@query(
    "cohort_posterior",
    f"""WITH {SCORED} SELECT series, seq, threshold::DOUBLE AS threshold, cohort_kind, cohort_samples, all_n AS scored_samples,
      candidate::DOUBLE AS candidate, CASE WHEN all_n >= 150 AND cohort_samples >= 50 THEN 'HIGH'
      WHEN all_n >= 60 AND cohort_samples >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS support FROM cohort""",
)
def _(spark, sf_dir):
    rows = forecast.cohort_posterior(_scored(spark, sf_dir))
    return rows.select(
        "series", "seq", "threshold", "cohort_kind", "cohort_samples", "scored_samples", "candidate", "support"
    )


GATED = f"""{SCORED}, homes AS (
  SELECT *, '' AS home, cohort_kind = 'global' AS judged FROM cohort
  UNION ALL SELECT *, trigger_signature AS home, cohort_kind = 'same_trigger' AS judged FROM cohort),
ordered AS (SELECT *, count(outcome) OVER (PARTITION BY series, threshold, home ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM homes),
known AS (SELECT series, threshold, home, before AS place, (candidate - outcome) * (candidate - outcome) AS cl,
    (CAST(prior AS DECIMAL(18,6)) - outcome) * (CAST(prior AS DECIMAL(18,6)) - outcome) AS pl FROM ordered WHERE outcome IS NOT NULL),
judged AS (SELECT * FROM ordered WHERE judged),
gate AS (SELECT j.series, j.seq, j.threshold, any_value(j.candidate) AS candidate, any_value(j.prior) AS prior, count(k.place) AS validation_samples,
    avg(k.cl) AS cb, avg(k.pl) AS pb
  FROM judged j LEFT JOIN known k ON k.series = j.series AND k.threshold = j.threshold AND k.home = j.home AND k.place < j.before AND k.place >= j.before - 60
  GROUP BY ALL),
decided AS (SELECT *, CASE WHEN validation_samples >= 16 THEN CASE WHEN pb > 0 THEN round_even((pb - cb) / pb * 100, 6) ELSE 0 END END AS skill FROM gate)"""


@query(
    "forward_gate",
    f"""WITH {GATED} SELECT series, seq, threshold::DOUBLE AS threshold, validation_samples,
    CASE WHEN validation_samples >= 16 THEN round_even(cb, 6) END AS candidate_brier,
    CASE WHEN validation_samples >= 16 THEN round_even(pb, 6) END AS prior_brier,
    CASE WHEN skill >= 5 THEN 'prospective_adjusted' ELSE 'historical_prior' END AS source FROM decided""",
)
def _(spark, sf_dir):
    rows = forecast.forward_gate(forecast.cohort_posterior(_scored(spark, sf_dir)))
    return rows.select("series", "seq", "threshold", "validation_samples", "candidate_brier", "prior_brier", "source")


@query(
    "selected_probabilities",
    f"""WITH {GATED} SELECT series, seq, threshold::DOUBLE AS threshold,
    min(CASE WHEN skill >= 5 THEN candidate::DOUBLE ELSE prior END) OVER (PARTITION BY series, seq ORDER BY threshold) AS probability FROM decided""",
)
def _(spark, sf_dir):
    rows = forecast.forward_gate(forecast.cohort_posterior(_scored(spark, sf_dir)))
    return forecast.selected_probabilities(rows).select("series", "seq", "threshold", "probability")


def _locks(spark, sf_dir):
    event_id = F.col("outcome_id").cast("bigint")
    text = F.create_map(F.lit("1.5"), F.lit("0.500000"))
    kept = F.when(event_id % 2 == 0, text)
    empty = F.lit(None).cast("map<string,string>")
    return D.outcomes(spark, sf_dir).select(
        "series", event_id.alias("seq"),
        F.when(event_id % 15 == 0, "unknown").otherwise(F.col("outcome_id")).alias("previous_round_id"),
        F.struct(
            kept.alias("historical_probabilities"), empty.alias("probabilities"),
            empty.alias("candidate_probabilities"),
            F.lit(None).cast("boolean").alias("prior_reconstructed_for_audit"),
        ).alias("forecast"),
    )


def _rebuilt(spark, sf_dir, locks):
    rows = forecast.reconstruct_prior(locks, D.outcomes(spark, sf_dir), D.THRESHOLDS)
    return rows.select(
        "series", "seq", F.col("forecast.historical_probabilities")["20"].cast("double").alias("p20"),
        F.coalesce("forecast.prior_reconstructed_for_audit", F.lit(False)).alias("rebuilt"),
    )


@query(
    "reconstruct_prior_all",
    f"""WITH {FREQUENCY} SELECT series, event_id AS seq,
      CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 15 = 0 THEN NULL ELSE max(round_even((hits + actual) / (n + 1), 6)) FILTER (threshold = 20.0) END AS p20,
      event_id % 2 = 1 AND event_id % 15 <> 0 AS rebuilt
    FROM forecast GROUP BY series, event_id""",
)
def _(spark, sf_dir):
    return _rebuilt(spark, sf_dir, _locks(spark, sf_dir))


# --- online models and state ---------------------------------------------------------------


def _state(spark, sf_dir):
    rows = features.state_samples_at_outcome(
        D.user_outcomes(spark, sf_dir, True), D.observations(spark, sf_dir, True),
        (2 * D.HOUR, 8 * D.HOUR), 1,
    )
    return settle(rows)


@query("online_rls")
def _(spark, sf_dir):
    rows = evaluate.ordered_samples(_state(spark, sf_dir))
    samples = rows.select(
        "series", F.lit("history").alias("mode"), "pos", online.clipped(F.col("history")).alias("x"),
        evaluate._hits("actual", D.THRESHOLDS).alias("hits"),
    )
    out = online.online_rls(samples)
    return out.select("series", "factor", "pos", *[F.bround(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(4)])


RLS_OF_ONE = f"""{users(True)}, {THRESHOLD_ROWS}, f(factor) AS (VALUES (0.9::DOUBLE), (0.95::DOUBLE), (0.98::DOUBLE), (1.0::DOUBLE)),
    s AS (SELECT series, value, row_number() OVER w - 2 AS pos, ln(least(lag(value) OVER w::DOUBLE, 1000.0)) AS x FROM user_outcomes WINDOW w AS (PARTITION BY series ORDER BY ts, outcome_id)),
    k AS (SELECT *, CASE WHEN value >= threshold THEN 1.0::DOUBLE ELSE 0.0 END AS y, power(factor, -(pos + 1)) AS k, power(factor, pos) AS fade, 10 * greatest(power(factor, pos), 1e-8) AS held
      FROM s, th, f WHERE pos >= 0),
    g AS (SELECT *, held + fade * coalesce(sum(k) OVER w, 0) AS g00, fade * coalesce(sum(k * x) OVER w, 0) AS g01, held + fade * coalesce(sum(k * x * x) OVER w, 0) AS g11,
      0.5 * held + fade * coalesce(sum(k * y) OVER w, 0) AS b0, fade * coalesce(sum(k * x * y) OVER w, 0) AS b1 FROM k
      WINDOW w AS (PARTITION BY series, factor, threshold ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT series, factor, pos, threshold, y, least(0.999, greatest(0.001, ((b0 * g11 - b1 * g01) + (g00 * b1 - g01 * b0) * x) / (g00 * g11 - g01 * g01))) AS probability FROM g)"""


def _rls_of_one(spark, sf_dir):
    """Online models on the logarithm before, which SQL can solve too."""
    rows = features.lag_log_features(D.user_outcomes(spark, sf_dir, True), 1, 1, warm_only=False).where("pos >= 1")
    hits = evaluate._hits("value", D.THRESHOLDS)
    return online.online_rls(rows.select("series", F.lit("history").alias("mode"), (F.col("pos") - 1).alias("pos"), F.array("log_value_lag_1").alias("x"), hits.alias("hits")))


@query("online_rls_of_one", f"WITH {RLS_OF_ONE} SELECT series, factor, pos, threshold::DOUBLE AS threshold, round_even(probability, 6) AS probability FROM p")
def _(spark, sf_dir):
    limits = F.array(*[F.lit(float(t)) for t in D.THRESHOLDS])
    rows = _rls_of_one(spark, sf_dir).select("series", "factor", "pos", F.posexplode("probabilities").alias("i", "p"))
    return rows.select("series", "factor", "pos", F.get(limits, "i").alias("threshold"), F.bround("p", 6).alias("probability"))


@query(
    "champion_selection_of_one",
    f"""WITH {RLS_OF_ONE}, l AS (SELECT *, avg((probability - y) * (probability - y)) OVER (PARTITION BY series, threshold, factor ORDER BY pos ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS recent FROM p)
    SELECT series, threshold::DOUBLE AS threshold, pos AS at, 'history:ff=' || format('{{:.2f}}', factor) AS champion, round_even(probability, 6) AS probability
    FROM l WHERE pos >= 40 QUALIFY row_number() OVER (PARTITION BY series, threshold, pos ORDER BY round(recent, 12), factor) = 1""",
)
def _(spark, sf_dir):
    name = F.concat_ws(":ff=", F.col("mode"), F.format_number("factor", 2))
    losses = online.candidate_losses(_rls_of_one(spark, sf_dir), D.THRESHOLDS, 16, name).withColumn("recent_loss", F.round("recent_loss", 12))
    chosen = online.champion_selection(losses.where("at >= 40"))
    return chosen.select(
        "series", F.col("threshold").cast("double").alias("threshold"), "at", F.col("champion.name").alias("champion"), F.bround("champion.probability", 6).alias("probability")
    )


@query("champion_selection")
def _(spark, sf_dir):
    rows = evaluate.prequential_predictions(_state(spark, sf_dir), D.THRESHOLDS)
    return rows.select(
        "series", "threshold", "at", F.col("champion.name").alias("champion"),
        F.bround("champion.probability", 6).alias("probability"),
    )


@query("walk_forward_state")
def _(spark, sf_dir):
    return evaluate.walk_forward_state(_state(spark, sf_dir))


@query("prequential_adaptive_audit")
def _(spark, sf_dir):
    return evaluate.prequential_adaptive_audit(_state(spark, sf_dir), D.THRESHOLDS)


@query(
    "block_wins",
    f"""WITH {FREQUENCY}, l AS (SELECT series, threshold, (probability - actual) * (probability - actual) AS a, (0.5 - actual) * (0.5 - actual) AS b,
      row_number() OVER (PARTITION BY series, threshold ORDER BY ts, outcome_id) - 1 AS j, count(*) OVER (PARTITION BY series, threshold) AS n FROM forecast WHERE n >= 50),
    k AS (SELECT l.series, l.threshold, avg(a) AS a, avg(b) AS b FROM l, range(7) r(blk) WHERE j >= blk * n // 7 AND j < (blk + 1) * n // 7 GROUP BY l.series, l.threshold, blk)
    SELECT series, threshold::DOUBLE AS threshold, count(*) FILTER (a < b) AS block_wins FROM k GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = forecast.frequency_forecast(D.outcomes(spark, sf_dir), D.THRESHOLDS).where("status = 'READY'")
    rows = rows.withColumns(
        {
            "a": F.pow(F.col("probability").cast("double") - F.col("actual"), 2),
            "b": F.pow(0.5 - F.col("actual"), 2),
            "j": F.col("sample_count") - 50,
        }
    )
    return evaluate.block_wins(rows, ["series", "threshold"], "j", "a", "b", 7)


@query(
    "switches",
    f"""WITH {OUTCOMES}, s AS (SELECT series, CAST(json_extract(post_data, '$.k') AS INTEGER) % 3 AS k, event_id FROM outcomes)
    SELECT series, count(*) FILTER (k <> before) AS switches FROM (SELECT *, lag(k) OVER (PARTITION BY series ORDER BY event_id) AS before FROM s) GROUP BY series""",
)
def _(spark, sf_dir):
    k = F.get_json_object("post_data", "$.k").cast("int") % 3
    rows = D.outcomes(spark, sf_dir).select("series", F.col("outcome_id").cast("bigint").alias("at"), k.alias("k"))
    return evaluate.switches(rows, ["series"], "at", "k")


def _snapshot_samples(spark, sf_dir):
    """Snapshots locked at triggers, scored with their target."""
    fired = _fired(spark, sf_dir)[1]
    seen = features.signature_sequence(fired, D.observations(spark, sf_dir, True))
    outcomes = D.user_outcomes(spark, sf_dir, True)
    priors = forecast.frequency_forecast(outcomes, D.THRESHOLDS, min_history=10).where("status = 'READY'")
    priors = priors.groupBy("series", F.col("ts").alias("target_ts")).agg(
        F.max("value").cast("double").alias("actual"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("threshold", "probability"))),
            lambda e: e["probability"].cast("double"),
        ).alias("priors"),
    )
    marks = fired.select(
        "series", "target_ts", F.col("signature").alias("trigger_signature"),
        F.col("score").alias("trigger_score"),
        F.col("age_seconds").alias("trigger_age_after_previous_seconds"),
    )
    locks = seen.join(marks, ["series", "target_ts"]).join(priors, ["series", "target_ts"])
    rows = features.hashed_features(locks)
    return rows.select(
        "series", F.unix_micros("target_ts").alias("seq"), "trigger_signature", "actual", "priors", "vector"
    )


@query("prospective_feature_audit")
def _(spark, sf_dir):
    return evaluate.prospective_feature_audit(settle(_snapshot_samples(spark, sf_dir)), D.THRESHOLDS, min_training=20)


# --- ledgers ---------------------------------------------------------------------------------

LEDGER = f"""{FREQUENCY},
locks AS (SELECT series, event_id, any_value(value) AS value, any_value(n) AS history_count FROM forecast WHERE n >= 50 GROUP BY series, event_id),
probs AS (SELECT series, event_id, threshold, value, actual, CAST(probability AS DECIMAL(18,6)) AS base,
    CAST(round_even((hits + 1) / (n + 2), 6) AS DECIMAL(18,6)) AS raw FROM forecast WHERE n >= 50),
pairs AS (SELECT * FROM locks WHERE event_id % 97 <> 0 AND event_id % 17 <> 0),
scores AS (SELECT p.series, p.event_id, threshold, actual AS outcome,
    CASE WHEN p.event_id % 3 = 0 AND p.event_id % 5 <> 0 THEN raw ELSE base END AS chosen, base AS baseline,
    CASE WHEN p.event_id % 5 <> 0 THEN raw END AS candidate, p.event_id % 3 = 0 AS selected, p.value
  FROM probs p JOIN pairs USING (series, event_id)),
losses AS (SELECT *, round_even((chosen - outcome) * (chosen - outcome), 6) AS chosen_brier, round_even((baseline - outcome) * (baseline - outcome), 6) AS baseline_brier,
    round_even((candidate - outcome) * (candidate - outcome), 6) AS candidate_brier FROM scores)"""


def _ledger(spark, sf_dir):
    return D.ledger(spark, sf_dir)


@query(
    "lock_score_pairing",
    f"WITH {LEDGER} SELECT series, 'lock-' || event_id AS lock_id, event_id * 5 + 2 AS scored_seq, value::DOUBLE AS actual FROM pairs",
)
def _(spark, sf_dir):
    return ledger.lock_score_pairing(_ledger(spark, sf_dir)).drop("lock")


@query(
    "open_locks",
    f"""WITH {LEDGER} SELECT series, 'lock-' || max(event_id) AS lock_id, max(event_id) * 5 AS seq FROM locks WHERE event_id % 97 = 0 AND event_id % 17 <> 0 GROUP BY series""",
)
def _(spark, sf_dir):
    return ledger.open_locks(_ledger(spark, sf_dir)).select("series", "lock_id", "seq")


@query(
    "latest_arm",
    f"""WITH {LEDGER} SELECT series, 'session-' || (event_id % 3) AS collector_session_id, max(event_id) * 5 + 4 AS seq, arg_max(history_count, event_id) AS history_count
    FROM locks WHERE event_id % 100 = 0 GROUP BY ALL""",
)
def _(spark, sf_dir):
    return ledger.latest_arm(_ledger(spark, sf_dir)).select("series", "collector_session_id", "seq", "history_count")


@query(
    "score_forecasts",
    f"""WITH {LEDGER} SELECT series, 'lock-' || event_id AS lock_id, threshold::DOUBLE AS threshold, outcome, chosen::DOUBLE AS chosen,
    chosen_brier::DOUBLE AS chosen_brier, baseline_brier::DOUBLE AS baseline_brier, candidate_brier::DOUBLE AS candidate_brier,
    round_even(abs(100 - value), 2)::DOUBLE AS absolute_error, round_even(round_even(abs(100 - value), 2)::DOUBLE / value::DOUBLE, 6) AS relative_error,
    value BETWEEN 50 AND 150 AS within_interval FROM losses""",
)
def _(spark, sf_dir):
    rows = ledger.score_forecasts(ledger.lock_score_pairing(_ledger(spark, sf_dir)))
    return rows.select(
        "series", "lock_id", "threshold", "outcome", "chosen", "chosen_brier", "baseline_brier",
        "candidate_brier", "absolute_error", "relative_error", "within_interval",
    )


_AUDIT = """count(*) AS scored_forecasts, count(*) FILTER (selected) AS challenger_selected,
    round_even(count(*) FILTER (selected) / count(*), 6) AS challenger_selection_rate,
    round_even(sum(chosen_brier)::DOUBLE / count(*), 6) AS mean_chosen_brier, round_even(sum(baseline_brier)::DOUBLE / count(*), 6) AS mean_baseline_brier,
    round_even(sum(candidate_brier)::DOUBLE / count(candidate_brier), 6) AS mean_raw_candidate_brier,
    round_even(sum(baseline_brier) FILTER (candidate_brier IS NOT NULL)::DOUBLE / count(candidate_brier), 6) AS comparable,
    count(candidate_brier) AS comparable_candidate_rows,
    round_even(sum(chosen)::DOUBLE / count(*), 6) AS average_forecast, round_even(sum(outcome) / count(*), 6) AS observed_rate"""


@query(
    "live_forecast_audit",
    f"""WITH {LEDGER}, a AS (SELECT threshold::DOUBLE AS threshold, {_AUDIT} FROM losses GROUP BY threshold)
    SELECT * EXCLUDE (comparable), round_even((mean_baseline_brier - mean_chosen_brier) / mean_baseline_brier * 100, 6) AS chosen_skill_vs_baseline_pct,
      round_even((comparable - mean_raw_candidate_brier) / comparable * 100, 6) AS raw_candidate_skill_vs_baseline_pct,
      round_even(observed_rate - average_forecast, 6) AS calibration_gap FROM a""",
)
def _(spark, sf_dir):
    return ledger.live_forecast_audit(_ledger(spark, sf_dir))


_TOTALS = """totals AS (SELECT l.series, count(DISTINCT CASE WHEN event_id % 17 = 0 THEN event_id END) AS invalidated_locks,
    CAST(coalesce(sum(CASE WHEN event_id % 23 = 0 THEN event_id % 3 + 1 END), 0) AS BIGINT) AS unpredicted_outcomes,
    count(*) FILTER (event_id % 97 <> 0 AND event_id % 17 <> 0) AS scored_locks FROM locks l GROUP BY l.series)"""


@query("ledger_totals", f"WITH {LEDGER}, {_TOTALS} SELECT * FROM totals")
def _(spark, sf_dir):
    return ledger.ledger_totals(_ledger(spark, sf_dir), ["series"])


@query(
    "performance_summary",
    f"""WITH {LEDGER}, {_TOTALS}, a AS (SELECT series, threshold::DOUBLE AS threshold, {_AUDIT} FROM losses GROUP BY series, threshold)
    SELECT * EXCLUDE (comparable, comparable_candidate_rows), round_even((mean_baseline_brier - mean_chosen_brier) / mean_baseline_brier * 100, 6) AS chosen_skill_vs_baseline_pct,
      round_even(observed_rate - average_forecast, 6) AS calibration_gap, 'COMPLETE' AS status FROM totals JOIN a USING (series)""",
)
def _(spark, sf_dir):
    return ledger.performance_summary(_ledger(spark, sf_dir), ["series"])


@query(
    "current_forecast",
    f"""WITH {LEDGER}, o AS (SELECT series, max(event_id) AS m FROM locks WHERE event_id % 97 = 0 AND event_id % 17 <> 0 GROUP BY series)
    SELECT s.series, 'lock-' || m AS lock_id, CASE WHEN m IS NULL THEN 'WAITING_FOR_NEXT_LOCK' ELSE 'LOCKED' END AS status
    FROM (SELECT DISTINCT series FROM locks) s LEFT JOIN o USING (series)""",
)
def _(spark, sf_dir):
    return ledger.current_forecast(_ledger(spark, sf_dir)).select("series", "lock_id", "status")


@query(
    "skill_pct",
    f"""WITH {LEDGER} SELECT series, 'lock-' || event_id AS lock_id, threshold::DOUBLE AS threshold,
    CASE WHEN baseline_brier > 0 THEN round_even((baseline_brier::DOUBLE - chosen_brier::DOUBLE) / baseline_brier::DOUBLE * 100, 6) END AS or_null,
    CASE WHEN baseline_brier > 0 THEN round_even((baseline_brier::DOUBLE - chosen_brier::DOUBLE) / baseline_brier::DOUBLE * 100, 6) ELSE 0 END AS or_zero FROM losses""",
)
def _(spark, sf_dir):
    rows = ledger.score_forecasts(ledger.lock_score_pairing(_ledger(spark, sf_dir)))
    pair = (F.col("baseline_brier"), F.col("chosen_brier"))
    return rows.select(
        "series", "lock_id", "threshold", C.skill_pct(*pair).alias("or_null"),
        C.skill_pct(*pair, "zero").alias("or_zero"),
    )
