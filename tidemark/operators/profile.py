"""Profiles of observations: kinds, transports, frame classes, and what surrounds markers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.plans.lineage import settle
from tidemark.plans.ordering import plan_layout, scan, window
from tidemark.plans.quantiles import fits_one_task, medians, weighted_medians
from tidemark.sources.observations import FRAME_KINDS, LIVE_KINDS

# Rows of (marker, class) that one part of a time bin, and one task, are to hold.
PART_PAIRS = 500_000
TASK_PAIRS = 1_000_000

# Fragments that make a JSON path interesting.
CANDIDATE_TERMS = [
    "round", "multiplier", "coefficient", "result", "crash", "payout",
    "gameid", "game_id", "roundid", "round_id", "status",
]


def _interesting(path: Column) -> Column:
    return F.regexp_replace(F.lower(path), "-", "_").rlike("|".join(CANDIDATE_TERMS))


def _top_paths(observations: DataFrame, by: Sequence[str], most: int | None = None) -> DataFrame:
    """The JSON paths per group, most frequent first, ties by path; all, or the first ``most``."""
    paths = observations.select(*by, F.explode("shape.path").alias("path")).where("path is not null")
    counts = paths.groupBy(*by, "path").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "path")
    top = counts.withColumn("r", F.row_number().over(order))
    if most is not None:
        top = top.where(F.col("r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("r", "path", "n")))
    return top.groupBy(*by).agg(
        F.transform(listed, lambda e: F.struct(e["path"].alias("path"), e["n"].alias("n"))).alias(
            "json_paths"
        )
    )


def _candidates(paths: str) -> Column:
    kept = F.filter(paths, lambda e: _interesting(e["path"]))
    return F.coalesce(kept, F.slice(F.col(paths), 1, 0))


def _histograms(observations: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """One sorted array of (bucket, n) per group and named column, from one melt."""
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("h"), F.col(c).cast("double").alias("bucket"))
                for name, c in columns.items()
            ]
        )
    )
    melted = observations.select(*by, entries.alias("e")).select(*by, "e.*")
    counts = melted.where("bucket is not null").groupBy(*by, "h", "bucket").agg(
        F.count("*").alias("n")
    )

    def one(name: str) -> Column:
        pairs = F.collect_list(F.when(F.col("h") == name, F.struct("bucket", "n")))
        return F.array_sort(pairs).alias(name)

    return counts.groupBy(*by).agg(*[one(name) for name in columns])


def profile_kinds(observations: DataFrame, most_paths: int | None = None) -> DataFrame:
    """Per (kind, url): events, paths (all, or the ``most_paths`` most frequent), interesting
    paths and status counts."""
    by = ["kind", "url"]
    rows = observations.where("kind is not null and url is not null")
    events = rows.groupBy(*by).agg(F.count("*").alias("events"))
    report = events.join(_top_paths(rows, by, most_paths), by, "left").join(
        _histograms(rows, by, {"status_counts": "status"}), by, "left"
    )
    return report.withColumn("candidate_paths", _candidates("json_paths"))


def profile_transports(observations: DataFrame, most_paths: int | None = None) -> DataFrame:
    """Per URL of live traffic: volumes, formats, sizes, histograms and a ranking score.

    The score counts interesting paths among all, or among the ``most_paths`` most frequent."""
    rows = observations.where(F.col("kind").isin(LIVE_KINDS) & F.col("url").isNotNull())
    kind, fmt = F.col("kind"), F.col("payload_format")
    size = F.when(F.col("payload_bytes") >= 0, F.col("payload_bytes"))
    report = rows.groupBy("url").agg(
        F.count("*").alias("events"),
        F.count_if(kind.endswith("received")).alias("received_events"),
        F.count_if(kind.endswith("sent")).alias("sent_events"),
        *[F.count_if(fmt == f).alias(f"{f}_events") for f in ("json", "text", "binary")],
        F.min(size).alias("min_bytes"),
        F.max(size).alias("max_bytes"),
        F.count_distinct(size).alias("distinct_sizes"),
    )
    histograms = {
        "opcode_counts": "opcode",
        "entropy_buckets": "entropy",
        "printable_ratio_buckets": "printable_ratio",
        "zero_ratio_buckets": "zero_ratio",
        "high_bit_ratio_buckets": "high_bit_ratio",
        "unique_byte_buckets": "unique_byte_bucket",
    }
    report = report.join(_top_paths(rows, ["url"], most_paths), "url", "left").join(
        _histograms(rows, ["url"], histograms), "url", "left"
    )
    report = report.withColumn("candidate_paths", _candidates("json_paths"))
    found = F.coalesce(F.size("candidate_paths"), F.lit(0))
    score = (
        F.least(F.col("received_events"), F.lit(100))
        + found * 25
        + F.least(F.col("json_events"), F.lit(20)) * 2
        + F.least(F.col("distinct_sizes"), F.lit(20))
    )
    return report.withColumn("score", score).drop("json_paths")


CLASS = ["url", "direction", "size_band"]


def frame_classes(observations: DataFrame) -> DataFrame:
    """Per (url, direction, size band) of binary frames: timing and fingerprint modes.

    A mode with several equally frequent values is the smallest of them.
    """
    rows = observations.where(
        F.col("kind").isin(FRAME_KINDS)
        & (F.col("payload_format") == "binary")
        & (F.col("payload_bytes") >= 0)
        & F.col("url").isNotNull()
    ).withColumn("size_band", C.size_band("payload_bytes"))
    timed = rows.where("ts is not null").withColumn("us", C.micros("ts"))
    layout = plan_layout(timed, CLASS, "us")
    timed = scan(timed, CLASS, ["us", "obs_id"], prev={"before": F.col("us")}, layout=layout)
    timed = timed.withColumn("gap_ms", (F.col("us") - F.col("before")) / 1000.0)
    mean, std = F.avg("gap_ms"), F.stddev_pop("gap_ms")
    regular = F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), std / mean))
    timing = timed.groupBy(*CLASS).agg(
        F.count("*").alias("events"),
        F.bround(F.min("gap_ms"), 1).alias("min_gap_ms"),
        F.bround(F.max("gap_ms"), 1).alias("max_gap_ms"),
        F.when(mean > 0, F.bround(regular, 3)).otherwise(0.0).alias("periodicity_score"),
    )
    middle = medians(timed, CLASS, {"m": F.col("gap_ms")}, fits_one_task(timed))
    middle = middle.select(*CLASS, F.bround("m", 1).alias("median_gap_ms"))
    fields = {
        "entropy_mode": "entropy",
        "zero_ratio_mode": "zero_ratio",
        "high_bit_ratio_mode": "high_bit_ratio",
        "unique_byte_mode": "unique_byte_bucket",
    }
    modes = _histograms(rows, CLASS, fields)
    for name in fields:
        best = F.array_max(
            F.transform(name, lambda e: F.struct(e["n"], (-e["bucket"]).alias("neg")))
        )
        modes = modes.withColumn(name, -best["neg"])
    return timing.join(middle, CLASS, "left").join(modes, CLASS, "left")


def _band_frames(observations: DataFrame) -> DataFrame:
    return observations.where(
        F.col("kind").isin(FRAME_KINDS)
        & (F.col("payload_format") == "binary")
        & F.col("payload_bytes").isNotNull()
        & F.col("url").isNotNull()
        & F.col("ts").isNotNull()
    ).withColumn("us", C.micros("ts"))


def _marker_places(markers: DataFrame) -> DataFrame:
    """How many different markers of an event are at an instant (``weight``)."""
    marks = markers.select("series", "event", "marker_id", C.micros("ts").alias("at_us"))
    known = marks.where("series IS NOT NULL AND event IS NOT NULL AND at_us IS NOT NULL").distinct()
    return known.groupBy("series", "event", "at_us").agg(F.count("*").alias("weight"))


def nearby_totals(
    classed: DataFrame, markers: DataFrame, window_seconds: float, class_columns: Sequence[str]
) -> DataFrame:
    """Per event and class: pairs of a marker and an observation within the window.

    Counted from the observations: running totals of markers at both ends of the window around
    each, on one time line per event, so work is linear in rows and no pair is formed.
    """
    by = ["series", "event"]
    w = C.to_micros(window_seconds)
    places = _marker_places(markers)
    facts = places.select(*by, F.col("at_us").alias("us"), F.lit(1).alias("_side"), "weight")
    ends = F.array(
        F.struct((F.col("us") - w).alias("us"), F.lit(0).alias("_side"), F.lit(-1).alias("_sign")),
        F.struct((F.col("us") + w).alias("us"), F.lit(2).alias("_side"), F.lit(1).alias("_sign")),
    )
    seen = classed.join(places.select(*by).distinct(), "series")
    points = seen.select(*by, *class_columns, F.explode(ends).alias("_e")).select(*by, *class_columns, "_e.*")
    line = scan(
        facts.unionByName(points, allowMissingColumns=True), by, ["us", "_side"],
        sums={"_n": F.coalesce(F.col("weight"), F.lit(0)).cast("bigint")},
    )
    totals = line.where("_sign IS NOT NULL").groupBy(*by, *class_columns).agg(
        F.sum(F.col("_n") * F.col("_sign")).alias("nearby_frames")
    )
    return totals.where("nearby_frames > 0")


def nearest_offsets(
    classed: DataFrame, markers: DataFrame, window_seconds: float, class_columns: Sequence[str], small: bool
) -> DataFrame:
    """Per marker place and class with an observation in the window: the nearest offset.

    Time is cut into bins; observations also go to the bin beside theirs that their window
    reaches, so the nearest one of any marker is in the marker's bin. Rows meet once, by bin;
    markers are spread over the classes of their bin only behind that exchange. Bins of many
    pairs are dealt to parts by marker. ``weight`` counts markers at the same instant.
    """
    w = C.to_micros(window_seconds)
    width = F.lit(max(2 * w, 1))
    label = F.struct(*class_columns)
    reach = F.sequence(F.floor((F.col("us") - w) / width), F.floor((F.col("us") + w) / width))
    seen = classed.where("series IS NOT NULL").select("series", label.alias("_class"), "us").distinct()
    seen = seen.withColumn("bin", F.explode(reach))
    marks = _marker_places(markers).withColumn("bin", F.floor(F.col("at_us") / width))
    present = seen.groupBy("series", "bin").agg(F.collect_set("_class").alias("_classes"), F.count("*").alias("_facts"))
    counts = marks.groupBy("series", "bin").agg(F.count("*").alias("_marks"))
    pairs = F.col("_marks") * F.size("_classes")
    bins = present.join(counts, ["series", "bin"]).withColumns(
        {"_parts": F.ceil(pairs / PART_PAIRS).cast("int"), "_rows": pairs}
    ).withColumn("_rows", F.col("_rows") + F.col("_facts") * F.col("_parts"))
    number = None
    if not small:
        bins = settle(bins)
        total = bins.agg(F.sum("_rows")).first()[0] or 0
        number = max(int(classed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_PAIRS))
    part = F.pmod(F.hash("at_us", "event"), F.col("_parts"))
    at = marks.join(bins.select("series", "bin", "_parts", "_classes"), ["series", "bin"]).select(
        "series", "bin", part.alias("_part"), F.col("at_us").alias("us"), F.lit(2).alias("_side"), "event", "weight",
        "_classes",
    )
    own = seen.join(bins.select("series", "bin", "_parts"), ["series", "bin"]).select(
        "series", "bin", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "us",
        F.lit(1).alias("_side"), F.array("_class").alias("_classes"),
    )
    keys = ["series", "bin", "_part"]
    met = own.unionByName(at, allowMissingColumns=True)
    met = met.repartition(*([number] if number else []), *keys)
    line = met.withColumn("_class", F.explode("_classes")).drop("_classes")
    keys = [*keys, "_class"]
    earlier = window(keys, ["us", "_side"]).rowsBetween(Window.unboundedPreceding, -1)
    later = window(keys, ["us", "_side"], reverse=True).rowsBetween(Window.unboundedPreceding, -1)
    fact = F.when(F.col("_side") == 1, F.col("us"))
    line = line.withColumns(
        {"_last": F.last(fact, ignorenulls=True).over(earlier), "_next": F.last(fact, ignorenulls=True).over(later)}
    ).where("_side = 2")
    back, ahead = F.col("_last") - F.col("us"), F.col("_next") - F.col("us")
    nearest = F.when(ahead.isNull() | (F.abs(back) <= ahead), back).otherwise(ahead)
    return line.select(
        "series", "event", "_class.*", "weight", nearest.alias("nearest_us")
    ).where(F.abs("nearest_us") <= w)


def _labelled(observations: DataFrame) -> DataFrame:
    label = F.concat_ws(":", F.col("direction"), C.size_band("payload_bytes"))
    return _band_frames(observations).withColumn("frame_class", label)


def marker_correlation(
    observations: DataFrame, markers: DataFrame, window_seconds: float = 1.5, top: int = 20
) -> DataFrame:
    """The most frequent frame classes near each marker event; ties by class."""
    counts = nearby_totals(
        _labelled(observations).select("series", "us", "url", "frame_class"),
        markers, window_seconds, ["url", "frame_class"],
    )
    order = Window.partitionBy("series", "event").orderBy(
        F.desc("nearby_frames"), "url", "frame_class"
    )
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = markers.groupBy("series", "event").agg(F.count("*").alias("markers"))
    return ranked.join(totals, ["series", "event"])


def _enrichment(
    classed: DataFrame,
    markers: DataFrame,
    window_seconds: float,
    class_columns: list[str],
    keep_zero: bool,
    min_total: int,
    expected_places: int,
) -> DataFrame:
    by = ["series", *class_columns]
    key = ["event", *by]
    small = fits_one_task(markers) and fits_one_task(classed)
    frames = nearby_totals(classed, markers, window_seconds, class_columns)
    near = nearest_offsets(classed, markers, window_seconds, class_columns, small)
    near = near.withColumn("nearest_ms", F.col("nearest_us") / 1000.0)
    hits = weighted_medians(near, key, "nearest_ms", "weight", "m", "hits", small)
    totals = classed.groupBy(*by).agg(
        F.count("*").alias("total"), F.min("us").alias("lo"), F.max("us").alias("hi")
    )
    spans = totals.groupBy("series").agg(
        ((F.max("hi") - F.min("lo")) / 1e6).alias("duration")
    )
    events = markers.groupBy("series", "event").agg(F.count("*").alias("markers"))
    # Event names times classes of a series: one row per line of the report.
    grid = events.join(totals.drop("lo", "hi"), "series").join(spans, "series")
    grid = grid.where((F.col("total") >= min_total) & (F.col("duration") > 0))
    report = grid.join(hits, key, "left" if keep_zero else "inner").join(frames, key, "left")
    expected = F.col("total") / F.col("duration") * (2.0 * window_seconds) * F.col("markers")
    nearby = F.coalesce("nearby_frames", F.lit(0))
    found = F.coalesce("hits", F.lit(0))
    return report.select(
        *key,
        "markers",
        found.alias("hits"),
        F.bround(found / F.col("markers"), 3).alias("hit_rate"),
        nearby.alias("nearby_frames"),
        F.bround(expected, expected_places).alias("expected_frames"),
        F.bround(nearby / expected, 2).alias("enrichment"),
        F.bround("m", 1).alias("median_nearest_offset_ms"),
    )


def marker_class_enrichment(
    observations: DataFrame, markers: DataFrame, window_seconds: float = 0.75
) -> DataFrame:
    """Enrichment of each frame class around each marker event; zero rows are kept."""
    classed = _labelled(observations).select("series", "us", "url", "frame_class")
    return _enrichment(classed, markers, window_seconds, ["url", "frame_class"], True, 1, 2)


def marker_signature_enrichment(
    observations: DataFrame,
    markers: DataFrame,
    window_seconds: float = 0.5,
    min_total_frames: int = 2,
) -> DataFrame:
    """The same by fine signature; signatures never near a marker are left out."""
    rows = _band_frames(observations).withColumn("signature", C.strict_signature())
    classed = rows.where("signature is not null").select("series", "us", "url", "signature")
    return _enrichment(
        classed, markers, window_seconds, ["url", "signature"], False, min_total_frames, 3
    )
