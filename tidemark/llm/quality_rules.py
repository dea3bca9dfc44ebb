"""Quality rules with adaptive thresholds, in DataFrame functions alone.

A statistic's distribution in each language and source is kept as a mergeable quantile
sketch: counts of values in log-linear bins, where values below 32 have bins of their own
and every power of two above is cut into 16 equal bins, so a quantile is off by less than
one part in 16. Sketches merge by adding counts: sources into languages, languages into
all. A statistic is too high where it exceeds its group's upper fence, the median plus
``FENCE`` times the distance from the median to the upper quartile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.shared import spread_join, text_of, written

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Groups of fewer documents take the thresholds of their language, then of all documents.
MIN_GROUP = 200
FENCE = 8
#: The least distance from median to quartile, so that equal values leave some room.
LEAST_SPREAD = {"symbol_rate": 5, "dup_rate": 25, "repeat_rate": 50, "word_tenths": 3}
#: Statistics that are judged, in whole numbers: thousandths, and tenths of a character.
RATES = list(LEAST_SPREAD)


def with_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """doc_id, lang, source and the base counts of every whole text, row by row."""
    lang, source = group_cols
    text = F.col("text")
    words = F.filter(F.split(text, SPACE + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    split = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), text_of(text_col).alias("text")
    ).select(
        "doc_id", "lang", "source",
        words.alias("words"), lines.alias("lines"),
        F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    # A window stands for the hash of its three words; equal hashes of one text are equal windows.
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(
        F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.element_at("words", i), F.element_at("words", i + 1), F.element_at("words", i + 2))
    )).otherwise(F.expr("cast(array() as array<bigint>)"))
    hashed = split.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    # Only texts with an equal pair are looked at window by window, sorted with their places.
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_ = hashed.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    at = lambda k: F.get(F.col("placed"), k)["h"]
    twice = F.transform(F.filter("placed", lambda p, k: F.coalesce(p["h"] == at(k - 1), F.lit(False)) | F.coalesce(p["h"] == at(k + 1), F.lit(False))), lambda p: p["i"])
    places = sorted_.withColumn("places", F.sort_array(twice)).drop("placed")
    covered = F.aggregate(
        F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get(F.col("places"), k + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x
    )
    return places.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words")
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """The statistics that are judged, as whole numbers; 0 for a text without words."""
    share = lambda a, b, unit: F.coalesce(F.floor(F.lit(unit) * F.col(a) / F.nullif(F.col(b), F.lit(0))), F.lit(0)).cast("long")
    return counts.withColumns({
        "symbol_rate": share("n_symbols", "word_chars", 1000),
        "dup_rate": F.col("n_dup_lines") * 25,
        "repeat_rate": share("n_repeat_words", "n_words", 1000),
        "word_tenths": share("word_chars", "n_words", 10),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    })


def bin_of(value: Column) -> Column:
    """The sketch's bin of a whole number from 0: its least value."""
    shift = F.greatest(F.lit(0), F.char_length(F.bin(value)) - 5)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rates: DataFrame) -> DataFrame:
    """lang, source, level, stat, bin, n: sketches by source, language and for all.

    Level 0 holds a source of a language, 1 a language, 2 everything. The counts are added
    up before the shuffle, so a hot source is a few hundred rows of each task.
    """
    one = rates.select("lang", "source", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RATES]), F.array(*[F.col(r) for r in RATES]))).alias("stat", "value"))
    own = one.groupBy("lang", "source", "stat", bin_of(F.col("value")).alias("bin")).agg(F.count("*").alias("n")).withColumn("level", F.lit(0))
    language = own.groupBy("lang", "stat", "bin").agg(F.sum("n").alias("n")).select("lang", F.lit(None).cast("string").alias("source"), "stat", "bin", "n", F.lit(1).alias("level"))
    every = own.groupBy("stat", "bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "stat", "bin", "n", F.lit(2).alias("level"))
    return own.unionByName(language).unionByName(every)


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source, level, n and an upper fence for each statistic."""
    keys = ["level", "lang", "source", "stat"]
    w = Window.partitionBy(*keys)
    ranked = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("total", F.sum("n").over(w))
    quantile = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bin")))
    by = ranked.groupBy(*keys).agg(quantile(50).alias("mid"), quantile(75).alias("high"), F.max("total").alias("n"))
    least = F.coalesce(*[F.when(F.col("stat") == s, F.lit(v)) for s, v in LEAST_SPREAD.items()])
    fence = F.col("mid") + FENCE * F.greatest(F.col("high") - F.col("mid"), least)
    return by.withColumn("fence", fence).groupBy("level", "lang", "source").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("stat") == s, F.col("fence"))).alias(f"{s}_fence") for s in RATES]
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source"), min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, kept, and the verdict's grounds.

    A document is kept if the base rules pass and no statistic exceeds the fence of its
    language and source; a group of fewer than ``min_group`` documents takes the fence of
    its language, a small language that of all. Null languages and sources are groups as any
    other. Null and empty texts have no words and fail the base rules; rows with null ids
    and repeated rows are judged each; an empty table gives no rows; other columns are not
    read.

    The counts are read twice, for the sketches and for the verdicts, from a written table
    of numbers; the fences, a row for each language and source, are joined to it.
    """
    rates = written(with_rates(with_counts(docs, id_col, text_col, group_cols)), "counts")
    fence = fences(sketches(rates))
    names = [f"{s}_fence" for s in RATES]
    level = lambda k, *cols: fence.where(F.col("level") == k).where(F.col("n") >= (min_group if k < 2 else 0)).select(*cols, F.struct(*names).alias(f"f{k}"))
    null_safe = lambda df, *cols: df.select(*[F.col(c).alias(f"{c}_") for c in cols], *[c for c in df.columns if c not in cols])
    own, language, every = null_safe(level(0, "lang", "source"), "lang", "source"), null_safe(level(1, "lang"), "lang"), level(2)
    groups = fence.where("level = 0").select("lang", "source")
    # Resolved for each group first: one join with the documents, a hot source's in parts.
    resolved = (
        groups.join(own, groups["lang"].eqNullSafe(F.col("lang_")) & groups["source"].eqNullSafe(F.col("source_")), "left").drop("lang_", "source_")
        .join(language, F.col("lang").eqNullSafe(F.col("lang_")), "left").drop("lang_")
        .join(F.broadcast(every))  # one row
        .select("lang", "source", F.coalesce("f0", "f1", "f2").alias("f"))
        .select("lang", "source", "f.*")
    )
    joined = spread_join(rates, resolved, ["lang", "source"], ["doc_id", "n_words", "word_chars"])
    high = F.lit(False)
    for s in RATES:
        high = high | (F.col(s) > F.coalesce(F.col(f"{s}_fence"), F.col(s)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~high).alias("kept")
    )
