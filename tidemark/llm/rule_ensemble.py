"""A quality classifier made of few rules that are Spark column expressions.

Shallow trees over statistics of the text are grown on labelled documents; every path from a
root is a rule, a conjunction of comparisons. A logistic regression with an L1 penalty gives
most rules the weight 0. What is left is compiled into one expression over the statistics.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.shared import bounded_sample, free_name, text_of, written

#: Labelled rows that are learned from at most, those with the least hashes of their ids.
MAX_LABELLED = 20_000
TREES = 12
DEPTH = 3
PENALTY = 0.002

Rule = tuple[tuple[str, str, float], ...]

STATISTICS = [
    "n_words", "word_length", "distinct_share", "echo_share", "upper_share", "digit_share", "symbol_share",
    "mark_share", "bar_share", "dup_line_share", "line_words",
]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column of statistics, counted row by row in Spark expressions.

    The struct comes out of a generator of one row: else a filter on a score would be pushed
    down with all statistics written out in each rule.
    """
    text = text_of(text_col)
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)).cast("double")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
    parts = free_name(docs, "parts")
    out = free_name(docs, "statistics")
    p = lambda c: F.col(f"`{parts}`.{c}")
    wide = docs.withColumn(parts, F.struct(
        words.alias("words"), lines.alias("lines"), F.char_length(text).alias("n_chars"),
        count(r"\p{Lu}").alias("upper"), count("[0-9]").alias("digits"), count("[#*$%&<>]").alias("symbols"),
        count("[!?]").alias("marks"), count(r"\|").alias("bars"),
    ))
    n, n_lines = F.size(p("words")), F.size(p("lines"))
    echoes = F.size(F.filter(p("words"), lambda w, i: F.coalesce(F.get(p("words"), i - 1) == w, F.lit(False))))
    made = F.struct(
        n.cast("double").alias("n_words"),
        share(p("n_chars"), n).alias("word_length"),
        share(F.size(F.array_distinct(p("words"))), n).alias("distinct_share"),
        share(echoes, n).alias("echo_share"),
        share(p("upper"), p("n_chars")).alias("upper_share"),
        share(p("digits"), p("n_chars")).alias("digit_share"),
        share(p("symbols"), n).alias("symbol_share"),
        share(p("marks"), n).alias("mark_share"),
        share(p("bars"), n).alias("bar_share"),
        share(n_lines - F.size(F.array_distinct(p("lines"))), n_lines).alias("dup_line_share"),
        share(n, n_lines).alias("line_words"),
    )
    return wide.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode_outer(F.array(made)).alias(out))


def is_held_out(doc_id: Column) -> Column:
    """The documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """Statistics and label of at most ``most`` labelled documents that are not held out.

    The chosen ids and labels, ``most`` rows of two numbers, are broadcast; so only the
    texts of these documents are read into statistics, without moving any text.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("label"))
    usable = ids.where("label_id is not null and label in (0, 1)").where(~is_held_out(F.col("label_id"))).distinct()
    chosen = bounded_sample(usable, F.struct("label_id", "label"), most)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    joined = source.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return with_statistics(joined).select("doc_id", "statistics.*", "label")


def rules_of_tree(text: str, names: list[str]) -> list[Rule]:
    """All paths of a fitted tree, from Spark's description of it."""
    rules, path = [], []
    for line in text.splitlines():
        found = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if found:
            depth = len(found[1])
            path = [p for p in path if p[0] < depth] + [(depth, (names[int(found[2])], found[3], float(found[4])))]
            rules.append(tuple(c for _, c in path))
    return rules


def tidy(rule: Rule) -> Rule:
    """The tightest comparison for each statistic and direction, in order."""
    bounds: dict[tuple[str, str], float] = {}
    for name, op, value in rule:
        have = bounds.get((name, op))
        bounds[name, op] = value if have is None else min(have, value) if op == "<=" else max(have, value)
    return tuple((name, op, value) for (name, op), value in sorted(bounds.items()))


def condition(rule: Rule, statistic) -> Column:
    out = None
    for name, op, value in rule:
        this = statistic(name) <= value if op == "<=" else statistic(name) > value
        out = this if out is None else out & this
    return out


class RuleModel:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, weights: dict[Rule, float]):
        self.intercept, self.weights = intercept, weights

    def score(self, statistic) -> Column:
        """The probability of label 1 as an expression; ``statistic`` gives a column by name."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(condition(rule, statistic), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        return [f"{w:+.4f} if " + " and ".join(f"{n} {o} {v:.6g}" for n, o, v in r) for r, w in sorted(self.weights.items(), key=lambda x: -abs(x[1]))]


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleModel:
    """Learns rules from statistics and a 0/1 label.

    With no rows or a single label there is nothing to tell apart: the model has no rules
    and gives the smoothed share of label 1.
    """
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    zeros, ones = counts.get(0.0, 0), counts.get(1.0, 0)
    if not zeros or not ones:
        return RuleModel(math.log((ones + 1) / (zeros + 1)), {})
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(rows)
    # Both labels weigh the same when trees split, so that rules for the rarer one are found.
    weighed = vectors.withColumn("weight", F.when(F.col("label") == 1, 1.0 / ones).otherwise(1.0 / zeros) * (ones + zeros) / 2)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=11, weightCol="weight", featureSubsetStrategy="0.5").fit(weighed.orderBy("doc_id").coalesce(1))
    rules = list(dict.fromkeys(tidy(r) for t in forest.trees for r in rules_of_tree(t.toDebugString, STATISTICS)))
    named = vectors.select("label", *[condition(r, F.col).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(named).select("label", "features").cache()
    try:
        model = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(matrix)
    finally:
        matrix.unpersist()
    return RuleModel(float(model.intercept), {r: float(w) for r, w in zip(rules, model.coefficients) if w})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> RuleModel:
    """The model for ``docs`` from their ``labels`` (doc_id, quality).

    At most ``most`` labelled documents are learned from; held-out ones never are.
    """
    return fit(written(labelled_rows(docs, labels, id_col, text_col, most), "labelled"))


def add_score(docs: DataFrame, model: RuleModel, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a score of every whole text, and the name of that column.

    One pass without a shuffle or Python. Null texts are empty; an empty text has statistics
    of 0 and gets the score of these. Ids, languages and sources are not looked at. Columns
    of ``docs`` stay; the new one gets underscores in front where its name is taken.
    """
    name = free_name(docs, "score")
    wide = with_statistics(docs, text_col)
    holder = wide.columns[-1]
    return wide.withColumn(name, model.score(lambda s: F.col(f"`{holder}`.{s}"))).drop(holder), name


def drop_rejected(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The documents with a score of 0.5 or more, in all their columns."""
    scored, name = add_score(docs, model, text_col)
    return scored.where(F.col(f"`{name}`") >= 0.5).drop(name)
