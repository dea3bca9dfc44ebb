"""Point-in-time features: every column uses rows strictly before its target only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators.temporal import sums_as_of, window_totals
from tidemark.plans.ordering import Layout, number, plan_layout, rolling, scan

RATE_THRESHOLDS = ("1.5", "2", "5")
SERIES, ORDER = ["series"], ["ts", "outcome_id"]

# Names of the state features of one window, in vector order.
STATE_FEATURES = [
    "log_event_count",
    "log_received_count",
    "log_sent_count",
    "log_total_bytes",
    "log_received_bytes",
    "log_sent_bytes",
    "received_binary_ratio",
    "sent_binary_ratio",
    "large_frame_ratio",
    "small_frame_ratio",
    "mean_entropy_bucket",
    "mean_zero_ratio",
    "mean_high_bit_ratio",
    "mean_unique_byte_fraction",
    "log_gap_mean_ms",
    "log_gap_std_ms",
    "log_unique_sockets",
]


def _last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-n, -1)


def _rate(threshold: str, frame: WindowSpec) -> Column:
    return F.avg(C.hit("value", F.lit(threshold).cast("decimal(18,6)")).cast("double")).over(frame)


def lag_names(lags: int, thresholds: Sequence[str]) -> list[str]:
    names = [f"log_value_lag_{i}" for i in range(1, lags + 1)]
    return [*names, "rolling_mean_log_value", *[f"rolling_rate_ge_{_plain(t)}" for t in thresholds]]


def _plain(threshold: str) -> str:
    return threshold.replace(".", "_")


def lag_log_features(
    outcomes: DataFrame,
    lags: int = 5,
    window: int = 20,
    thresholds: Sequence[str] = RATE_THRESHOLDS,
    warm_only: bool = True,
    layout: Layout | None = None,
) -> DataFrame:
    """Logs at lags 1..k, rolling mean log and rolling exceedance rates per target.

    Only targets with a full window are kept unless ``warm_only`` is off.
    """
    log = C.log_value("value")
    names = lag_names(lags, thresholds)

    def columns(w: WindowSpec) -> Mapping[str, Column]:
        frame = _last(w, window)
        values = [F.lag(log, i).over(w) for i in range(1, lags + 1)]
        values += [F.avg(log).over(frame), *[_rate(t, frame) for t in thresholds]]
        return dict(zip(names, values))

    rows = rolling(outcomes, SERIES, ORDER, max(window, lags), columns, layout)
    return rows.where(F.col("pos") >= window) if warm_only else rows


def regime_names(lags: int) -> list[str]:
    names = [f"log_value_lag_{i}" for i in range(1, lags + 1)]
    names += ["short_mean", "long_mean", "mean_shift", "short_std", "long_std"]
    return names + [f"{w}_rate_ge_{_plain(t)}" for t in RATE_THRESHOLDS for w in ("short", "long")]


def regime_columns(w: WindowSpec, lags: int, short: int, long: int) -> dict[str, Column]:
    """Lags, short and long means, spreads and rates of the rows before the current one."""
    log = C.log_value("value")
    near, far = _last(w, short), _last(w, long)
    values = [F.lag(log, i).over(w) for i in range(1, lags + 1)]
    values += [
        F.avg(log).over(near),
        F.avg(log).over(far),
        F.avg(log).over(near) - F.avg(log).over(far),
        F.stddev_pop(log).over(near),
        F.stddev_pop(log).over(far),
    ]
    values += [_rate(t, frame) for t in RATE_THRESHOLDS for frame in (near, far)]
    return dict(zip(regime_names(lags), values))


def regime_features(
    outcomes: DataFrame,
    lags: int = 5,
    short: int = 8,
    long: int = 20,
    layout: Layout | None = None,
) -> DataFrame:
    rows = rolling(
        outcomes, SERIES, ORDER, long, lambda w: regime_columns(w, lags, short, long), layout
    )
    return rows.where(F.col("pos") >= long)


def lags_array(value: Column, w: WindowSpec, n: int) -> Column:
    """The last ``n`` values before the current row, newest first, without padding."""
    return F.array_compact(F.array(*[F.lag(value, i).over(w) for i in range(1, n + 1)]))


def array_median(values: Column) -> Column:
    ordered = F.array_sort(values)
    count = F.size(values)
    low = F.try_element_at(ordered, F.floor((count + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, (F.floor(count / 2) + 1).cast("int"))
    return F.when(count > 0, (low + high) / 2)


def recent_median(outcomes: DataFrame, n: int = 8, layout: Layout | None = None) -> DataFrame:
    """Median of the last ``n`` earlier values (fewer at the start of a series)."""
    value = F.col("value").cast("double")
    return rolling(
        outcomes,
        SERIES,
        ORDER,
        n,
        lambda w: {"recent_median": array_median(lags_array(value, w, n))},
        layout,
    )


def ewma_of(newest_first: Column, alpha: float) -> Column:
    """Exponential average of a short array, seeded with its oldest value."""
    oldest_first = F.reverse(newest_first)
    rest = F.slice(oldest_first, 2, F.greatest(F.size(newest_first) - 1, F.lit(0)))
    first = F.try_element_at(oldest_first, F.lit(1))
    return F.aggregate(rest, first, lambda acc, x: x * alpha + acc * (1.0 - alpha))


def ewma(
    outcomes: DataFrame, short: int = 8, long: int = 20, layout: Layout | None = None
) -> DataFrame:
    """Recursive average of the last ``long`` logs with alpha = 2 / (short + 1)."""
    alpha = 2.0 / (short + 1.0)
    log = C.log_value("value")
    rows = rolling(
        outcomes,
        SERIES,
        ORDER,
        long,
        lambda w: {"ewma_log": ewma_of(lags_array(log, w, long), alpha)},
        layout,
    )
    return rows.where(F.col("pos") >= long)


def prefix_counts(
    outcomes: DataFrame, thresholds: Sequence[str] = RATE_THRESHOLDS, layout: Layout | None = None
) -> DataFrame:
    """``n`` and hits per threshold among the outcomes before each one, in one pass."""
    hits = {
        f"hits_{i}": C.hit("value", F.lit(t).cast("decimal(18,6)")).cast("bigint")
        for i, t in enumerate(thresholds)
    }
    sums = {"n": F.lit(1).cast("bigint"), **hits}
    return scan(outcomes, SERIES, ORDER, sums=sums, layout=layout)


# --- state of trailing windows -------------------------------------------------------


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def state_measures() -> dict[str, Column]:
    received = F.col("direction") == "received"
    sent = F.col("direction") == "sent"
    binary = F.col("payload_format") == "binary"
    size = F.col("payload_bytes")
    measures = {
        "n": F.lit(1).cast("bigint"),
        "received": _flag(received),
        "sent": _flag(sent),
        "bytes": size,
        "received_bytes": F.when(received, size).otherwise(0),
        "sent_bytes": F.when(sent, size).otherwise(0),
        "received_binary": _flag(received & binary),
        "sent_binary": _flag(sent & binary),
        "large": _flag(size >= 1024),
        "small": _flag(size < 128),
    }
    for short, name in (("e", "entropy"), ("z", "zero_ratio"), ("h", "high_bit_ratio")):
        value = F.when(binary, F.col(name))
        measures[f"{short}_n"] = value.isNotNull().cast("bigint")
        # Bucketed values carry at most a few decimals: millionths are exact.
        measures[f"{short}_sum"] = F.coalesce(F.round(value * 1e6).cast("bigint"), F.lit(0))
    unique = F.when(binary, F.col("unique_byte_bucket"))
    measures["u_n"] = unique.isNotNull().cast("bigint")
    measures["u_sum"] = F.coalesce(unique, F.lit(0)).cast("bigint")
    return measures


def state_vector(sockets: Column) -> list[Column]:
    """The 17 features of one window from its totals."""

    def d(name: str) -> Column:
        return F.col(name).cast("double")

    def share(top: str, bottom: str) -> Column:
        return d(top) / F.greatest(d(bottom), F.lit(1.0))

    def mean(short: str, scale: float) -> Column:
        count = d(f"{short}_n")
        return F.when(count > 0, d(f"{short}_sum") / scale / count).otherwise(0.0)

    n = d("n")
    return [
        F.log1p(n),
        F.log1p(d("received")),
        F.log1p(d("sent")),
        F.log1p(d("bytes")),
        F.log1p(d("received_bytes")),
        F.log1p(d("sent_bytes")),
        share("received_binary", "received"),
        share("sent_binary", "sent"),
        d("large") / n,
        d("small") / n,
        mean("e", 1e6),
        mean("z", 1e6),
        mean("h", 1e6),
        mean("u", 256.0),
        F.log1p("gap_mean_ms"),
        F.log1p("gap_std_ms"),
        F.log1p(sockets.cast("double")),
    ]


def gap_columns(totals: DataFrame) -> DataFrame:
    """Mean and population deviation of the gaps inside each window, in milliseconds."""
    gaps = F.col("n") - 1
    total_ms = (F.col("last_seen_us") - F.col("first_seen_next_us")).cast("double") / 1000.0
    # The gap that leads into the window belongs to its first observation.
    lead = F.col("first_seen_next_us") - F.coalesce("before_seen_us", "first_seen_next_us")
    lead = lead.cast("decimal(19,0)")
    squares = (F.col("gap2") - (lead * lead).cast("decimal(38,0)")).cast("double") / 1e6
    totals = totals.withColumn("gap_mean_ms", F.when(gaps > 0, total_ms / gaps).otherwise(0.0))
    mean2 = F.col("gap_mean_ms") * F.col("gap_mean_ms")
    spread = squares / gaps - mean2
    # Equal gaps leave only rounding noise.
    std = F.when(spread > mean2 * 1e-13, F.sqrt(spread)).otherwise(0.0)
    return totals.withColumn("gap_std_ms", F.when(gaps > 1, std).otherwise(0.0))


def window_state_features(
    points: DataFrame,
    observations: DataFrame,
    windows_seconds: Sequence[float],
    keys: Sequence[str],
    cutoff: str = "cutoff",
    since: str | None = None,
    layout: Layout | None = None,
) -> DataFrame:
    """State features of the observations up to a cutoff, per point.

    One vector per trailing window (cutoff - w, cutoff], and with ``since`` (the time
    of the outcome that opens the point's interval) one for (since, cutoff], placed
    first. Vectors are concatenated in ``state``; ``events_<i>`` counts the
    observations of vector i.

    Everything is a difference of running totals, also the number of distinct
    sockets: a socket counts from an observation until ``w`` after its last one, so
    the running sum of openings and closings is the distinct count at any cutoff.
    """
    layout = layout if layout is not None else plan_layout(observations, ["series"], "ts")
    widths = [C.to_micros(w) for w in sorted(windows_seconds)]
    obs = observations.withColumn("us", C.micros("ts"))
    obs = scan(obs, SERIES, ["us", "obs_id"], prev={"before_us": F.col("us")}, layout=layout)
    obs = scan(
        obs,
        ["series", "socket"],
        ["us", "obs_id"],
        prev={"socket_before": F.col("us")},
        next={"socket_after": F.col("us")},
        layout=layout,
    )
    gap = (F.col("us") - F.col("before_us")).cast("decimal(38,0)")
    measures = {
        **state_measures(),
        "gap2": F.coalesce((gap * gap).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")),
    }
    for i, w in enumerate(widths):
        fresh = F.col("socket_before").isNull() | (F.col("us") - F.col("socket_before") >= w)
        measures[f"sockets_{i}"] = _flag(fresh)
    if since is not None:
        # New in its interval: no earlier observation of the socket since it opened.
        starts = points.select("series", C.micros(since).alias("us")).distinct()
        opened = starts.select("series", "us", F.lit(1).alias("_side"), F.col("us").alias("_open"))
        line = obs.withColumn("_side", F.lit(0)).unionByName(opened, allowMissingColumns=True)
        line = scan(line, SERIES, ["us", "_side"], prev={"open_us": F.col("_open")}, layout=layout)
        obs = line.where(F.col("_side") == 0).drop("_side", "_open")
        known = F.col("socket_before") > F.col("open_us")
        measures["new_sockets"] = _flag(~F.coalesce(known, F.lit(False)))
    facts = obs.select("series", "us", F.col("us").alias("seen_us"), *[e.alias(n) for n, e in measures.items()])
    closings = [
        obs.where(F.col("socket_after").isNull() | (F.col("socket_after") - F.col("us") >= w)).select(
            "series", (F.col("us") + w).alias("us"), F.lit(-1).cast("bigint").alias(f"sockets_{i}")
        )
        for i, w in enumerate(widths)
    ]
    for closing in closings:
        facts = facts.unionByName(closing, allowMissingColumns=True)
    end = C.micros(cutoff)
    spans = [(end - w, end) for w in widths]
    if since is not None:
        spans.insert(0, (C.micros(since), end))
    numbers = [f"sockets_{i}" for i in range(len(widths))]
    totals = window_totals(
        facts,
        points,
        {n: F.col(n) for n in measures if n not in numbers},
        spans,
        keys,
        levels={n: F.col(n) for n in numbers},
        last={"seen_us": F.col("seen_us")},
        following={"seen_next_us": F.col("seen_us")},
        layout=layout,
    )
    totals = gap_columns(totals)
    offset = 0 if since is None else 1
    sockets = F.col("new_sockets") if since is not None else F.lit(None).cast("bigint")
    for i, name in enumerate(numbers):
        sockets = F.when(F.col("span") == i + offset, F.col(name)).otherwise(sockets)
    vector = F.when(F.col("n") > 0, F.array(*state_vector(sockets))).otherwise(
        F.array(*[F.lit(0.0)] * len(STATE_FEATURES))
    )
    parts = totals.select("series", *keys, "span", "n", vector.alias("v"))
    whole = parts.groupBy("series", *keys).agg(
        F.array_sort(F.collect_list(F.struct("span", "n", "v"))).alias("_p")
    )
    counts = [F.col("_p")[i]["n"].alias(f"events_{i}") for i in range(len(spans))]
    state = F.flatten(F.transform("_p", lambda e: e["v"]))
    return whole.select("series", *keys, *counts, state.alias("state"))


# --- aligned samples ------------------------------------------------------------------


def history_samples(outcomes: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Targets with a full warm-up: predecessor, recent median and history vector."""
    names = lag_names(5, RATE_THRESHOLDS)
    log, value = C.log_value("value"), F.col("value").cast("double")

    def columns(w: WindowSpec) -> Mapping[str, Column]:
        frame = _last(w, 20)
        vector = [F.lag(log, i).over(w) for i in range(1, 6)]
        vector += [F.avg(log).over(frame), *[_rate(t, frame) for t in RATE_THRESHOLDS]]
        return {
            "prev_ts": F.lag("ts").over(w),
            "baseline": array_median(lags_array(value, w, 8)),
            **dict(zip(names, vector)),
        }

    rows = rolling(
        outcomes.select("series", "ts", "outcome_id", "value"), SERIES, ORDER, 20, columns, layout
    )
    return rows.where((F.col("pos") >= 20) & (F.col("prev_ts") < F.col("ts"))).select(
        "series",
        F.col("outcome_id"),
        F.col("pos").alias("target_index"),
        "prev_ts",
        F.col("ts").alias("target_ts"),
        F.col("value").cast("double").alias("actual"),
        "baseline",
        F.array(*names).alias("history"),
    )


SAMPLE = ["series", "outcome_id", "target_index", "cutoff", "target_ts", "actual", "baseline"]


def _with_state(
    samples: DataFrame,
    observations: DataFrame,
    windows: Sequence[float],
    minimum: int,
    since: str | None,
    counted: str,
    lead: Sequence[Column] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    keys = [*dict.fromkeys([*SAMPLE[1:], "history", *([since] if since else []), *extra])]
    state = window_state_features(samples, observations, windows, keys, since=since)
    vector = F.concat(F.array(*lead), F.col("state")) if lead else F.col("state")
    return state.where(F.col(counted) >= minimum).select(
        *SAMPLE, *extra, F.col(counted).alias("window_events"), "history", vector.alias("state")
    )


def state_samples_at_outcome(
    outcomes: DataFrame,
    observations: DataFrame,
    windows_seconds: Sequence[float] = (2.0, 8.0),
    min_events: int = 3,
) -> DataFrame:
    """Samples whose state ends when the previous outcome completed."""
    samples = history_samples(outcomes).withColumn("cutoff", F.col("prev_ts"))
    longest = f"events_{len(windows_seconds) - 1}"
    return _with_state(samples, observations, windows_seconds, min_events, None, longest)


def _shifted(time: Column, seconds: Column | float) -> Column:
    delta = seconds * C.MICROS if isinstance(seconds, Column) else F.lit(C.to_micros(seconds))
    return F.timestamp_micros(F.unix_micros(time) + delta.cast("bigint"))


def _at_onsets(outcomes: DataFrame, onsets: DataFrame) -> DataFrame:
    found = onsets.select("series", "prev_ts", "target_ts", "onset_ts")
    return history_samples(outcomes).join(found, ["series", "prev_ts", "target_ts"])


def state_samples_prestart(
    outcomes: DataFrame,
    observations: DataFrame,
    onsets: DataFrame,
    margin_seconds: float = 0.5,
    windows_seconds: Sequence[float] = (0.75, 2.0, 5.0),
    min_events: int = 3,
) -> DataFrame:
    """Samples whose state ends a safety margin before the onset of the target."""
    samples = _at_onsets(outcomes, onsets).withColumn(
        "cutoff", _shifted(F.col("onset_ts"), -margin_seconds)
    )
    ordered = (F.col("prev_ts") < F.col("cutoff")) & (F.col("onset_ts") < F.col("target_ts"))
    age = C.seconds(C.micros("cutoff") - C.micros("prev_ts"))
    return _with_state(
        samples.where(ordered), observations, windows_seconds, min_events, "prev_ts", "events_0",
        [F.log1p(age)],
    )


def state_samples_checkpoint(
    outcomes: DataFrame,
    observations: DataFrame,
    onsets: DataFrame,
    delays_seconds: Sequence[float],
    windows_seconds: Sequence[float] = (0.75, 2.0, 5.0),
    min_events: int = 3,
) -> DataFrame:
    """Samples at fixed delays after the previous outcome, if the onset is later.

    All delays are built in one pass; ``delay_seconds`` tells them apart.
    """
    delays = F.explode(F.array(*[F.lit(float(d)) for d in delays_seconds]))
    samples = _at_onsets(outcomes, onsets).withColumn("delay_seconds", delays)
    samples = samples.withColumn("cutoff", _shifted(F.col("prev_ts"), F.col("delay_seconds")))
    ordered = (F.col("cutoff") < F.col("onset_ts")) & (F.col("onset_ts") < F.col("target_ts"))
    return _with_state(
        samples.where(ordered), observations, windows_seconds, min_events, "prev_ts", "events_0",
        [F.log1p("delay_seconds")], ["delay_seconds"],
    )


def state_samples_triggered(
    outcomes: DataFrame,
    observations: DataFrame,
    triggers: DataFrame,
    windows_seconds: Sequence[float] = (0.75, 2.0, 5.0),
    min_events: int = 2,
) -> DataFrame:
    """Samples whose state ends at the trigger of the target's interval.

    ``triggers`` carry the matching observation: its direction, format, size and
    fingerprint lead the vector, with the trigger's age, score and rank.
    """
    trigger = F.struct(*[c for c in triggers.columns if c not in ("series", "prev_ts", "target_ts")])
    found = triggers.select("series", "prev_ts", "target_ts", trigger.alias("trigger"))
    samples = history_samples(outcomes).join(found, ["series", "prev_ts", "target_ts"])
    samples = samples.withColumn("cutoff", F.col("trigger.trigger_ts"))

    def zero(name: str) -> Column:
        return F.coalesce(F.col(f"trigger.{name}").cast("double"), F.lit(0.0))

    lead = [
        F.log1p("trigger.age_seconds"),
        F.log1p("trigger.score"),
        1.0 / (1.0 + F.col("trigger.rank")),
        (F.col("trigger.direction") == "received").cast("double"),
        (F.col("trigger.payload_format") == "binary").cast("double"),
        F.log1p(F.col("trigger.payload_bytes").cast("double")),
        zero("entropy"),
        zero("zero_ratio"),
        zero("high_bit_ratio"),
        zero("unique_byte_bucket") / 256.0,
    ]
    ordered = (F.col("prev_ts") < F.col("cutoff")) & (F.col("cutoff") < F.col("target_ts"))
    return _with_state(
        samples.where(ordered), observations, windows_seconds, min_events, "prev_ts", "events_0",
        lead, ["trigger"],
    ).drop("trigger")


# --- signature sequences and hashed features ------------------------------------------


def signature_sequence(
    triggers: DataFrame,
    observations: DataFrame,
    length: int = 32,
    top: int = 64,
    layout: Layout | None = None,
) -> DataFrame:
    """What was seen in the interval up to a trigger, per trigger.

    Totals of the interval, and the signatures, their transitions and gaps over its
    last ``length`` observations. Observations are numbered once; a trigger fetches
    the positions it needs by key, so no interval is gathered whole.
    """
    layout = layout if layout is not None else plan_layout(observations, ["series"], "ts")
    obs = observations.withColumn("us", C.micros("ts"))
    measures = {
        "n": F.lit(1).cast("bigint"),
        "received": _flag(F.col("direction") == "received"),
        "sent": _flag(F.col("direction") == "sent"),
        "binary": _flag(F.col("payload_format") == "binary"),
        "bytes": F.col("payload_bytes"),
    }
    keys = ["prev_ts", "target_ts", "trigger_ts"]
    at = {"_lo": C.micros("prev_ts"), "_hi": C.micros("trigger_ts")}
    totals = sums_as_of(obs, triggers, measures, at, keys, layout=layout)
    spans = totals.select(
        "series",
        *keys,
        *[(F.col(f"_hi.{m}") - F.col(f"_lo.{m}")).alias(m) for m in measures],
        F.greatest(F.col("_lo.n"), F.col("_hi.n") - length).alias("_from"),
        (F.col("_hi.n") - 1).alias("_to"),
    ).where(F.col("n") > 0)
    tokens = number(
        obs.select("series", "us", "obs_id", C.observation_signature().alias("signature")),
        SERIES,
        ["us", "obs_id"],
        layout=layout,
    )
    wanted = spans.withColumn("pos", F.explode(F.sequence("_from", "_to")))
    found = wanted.join(tokens, ["series", "pos"]).groupBy("series", *keys).agg(
        F.array_sort(F.collect_list(F.struct("pos", "us", "signature"))).alias("seen"),
        *[F.first(m).alias(m) for m in measures],
    )
    names = F.transform("seen", lambda e: e["signature"])
    shifted = F.concat(F.array(C.micros("prev_ts")), F.transform("seen", lambda e: e["us"]))
    steps = F.zip_with(
        "seen",
        F.slice(shifted, 1, F.size("seen")),
        lambda e, before: F.struct(
            e["signature"].alias("signature"),
            F.round(F.greatest(e["us"] - before, F.lit(0)).cast("double") / 1000.0, 3).alias("gap_ms"),
        ),
    )
    pairs = F.zip_with(
        F.slice(names, 1, F.greatest(F.size("seen") - 1, F.lit(0))),
        F.slice(names, 2, F.size("seen")),
        lambda a, b: F.concat(a, F.lit(" -> "), b),
    )
    pairs = F.filter(pairs, lambda p: p.isNotNull())
    return found.select(
        "series",
        *keys,
        F.struct(
            F.col("n").alias("event_count_since_previous"),
            F.col("received").alias("received_count"),
            F.col("sent").alias("sent_count"),
            F.col("binary").alias("binary_count"),
            F.col("bytes").alias("total_payload_bytes"),
            count_map(names, top).alias("signature_counts"),
            count_map(pairs, top).alias("transition_counts"),
            steps.alias("recent_sequence"),
        ).alias("features"),
    )


def count_map(tokens: Column, top: int) -> Column:
    """Counts of the ``top`` most frequent tokens of a short array, ties by text."""
    counted = F.transform(
        F.array_distinct(tokens),
        lambda t: F.struct(
            (-F.size(F.filter(tokens, lambda u: u == t))).alias("neg"), t.alias("token")
        ),
    )
    best = F.slice(F.array_sort(counted), 1, top)
    return F.map_from_entries(
        F.transform(best, lambda e: F.struct(e["token"], (-e["neg"]).cast("bigint")))
    )


def _binned(entries: Column, bins: int) -> Column:
    """Dense vector from an array of struct(bin, weight)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda b: F.aggregate(
            F.filter(entries, lambda e: e["bin"] == b),
            F.lit(0.0),
            lambda acc, e: acc + e["weight"],
        ),
    )


def _hashed(token: Column, weight: Column, bins: int) -> Column:
    return F.struct(
        C.hash_bin(token, bins).cast("int").alias("bin"),
        (C.hash_sign(token) * weight).cast("double").alias("weight"),
    )


def hashed_features(locks: DataFrame, bins: int = 24) -> DataFrame:
    """Fixed-length vectors from locked snapshots: 10 scalars and four hashed groups."""
    if not 8 <= bins <= 128:
        raise ValueError("bins must be between 8 and 128.")

    def log_of(value: Column) -> Column:
        value = F.coalesce(value.cast("double"), F.lit(0.0))
        return F.log1p(F.greatest(value, F.lit(0.0)))

    def counts(name: str) -> Column:
        entries = F.coalesce(
            F.map_entries(f"features.{name}"),
            F.array().cast("array<struct<key:string,value:bigint>>"),
        )
        return _binned(
            F.transform(entries, lambda e: _hashed(e["key"], log_of(e["value"]), bins)), bins
        )

    sequence = F.coalesce(
        F.col("features.recent_sequence"),
        F.array().cast("array<struct<signature:string,gap_ms:double>>"),
    )
    length = F.greatest(F.size(sequence), F.lit(1)).cast("double")
    steps = F.transform(
        sequence,
        lambda e, i: _hashed(
            F.concat(F.lit("seq:"), e["signature"]), (i + 1).cast("double") / length, bins
        ),
    )
    gaps = F.transform(
        F.filter(sequence, lambda e: e["gap_ms"].isNotNull()),
        lambda e: F.greatest(e["gap_ms"], F.lit(0.0)),
    )
    count = F.size(gaps).cast("double")
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)
    mean = F.when(count > 0, total / count).otherwise(0.0)
    squares = F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + (g - mean) * (g - mean))
    std = F.when(count > 1, F.sqrt(squares / count)).otherwise(0.0)
    newest = F.coalesce(F.try_element_at(gaps, F.lit(-1)), F.lit(0.0))
    trigger = F.array(
        _hashed(F.concat(F.lit("trigger:"), F.col("trigger_signature")), F.lit(1.0), bins)
    )
    scalars = F.array(
        log_of(F.col("trigger_age_after_previous_seconds")),
        log_of(F.col("trigger_score")),
        *[
            log_of(F.col(f"features.{n}"))
            for n in (
                "event_count_since_previous", "received_count", "sent_count", "binary_count",
                "total_payload_bytes",
            )
        ],
        F.log1p(mean),
        F.log1p(std),
        F.log1p(newest),
    )
    vector = F.concat(
        scalars,
        counts("signature_counts"),
        counts("transition_counts"),
        _binned(F.filter(steps, lambda e: e["bin"].isNotNull()), bins),
        _binned(trigger, bins),
    )
    return locks.where(F.col("features").isNotNull()).withColumn("vector", vector)


