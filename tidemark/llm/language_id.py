"""Language identification in two steps: first the family, then one-versus-one linear SVMs within it.

Features are hashed character n-grams of words, so that a text's features are the sum of its
words' features, and its score the mean of its words' scores: a task scores each distinct word
of a batch once. Nothing but the text is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.shared import ODD, free_name, mixed, pieces, text_of

#: The answer for a text without a letter, or where nothing was learned.
UNDETERMINED = "und"

#: Hashed features.
BINS = 1 << 12

#: Lengths of n-grams.
GRAMS = (1, 2, 3, 4)

#: Distinct words that are looked at together.
WORDS = 20_000

#: Training texts in all, at most; each language has an equal part of them, but at least ``FEWEST``.
MOST_TEXTS, FEWEST = 2_400, 20

#: Families of common languages by ISO 639-1 code; a parameter.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "nb", "nn", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}

#: A row is held out if the CRC-32 of its id has this remainder.
FOLDS, HELD_OUT = 4, 2


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


# Words and their features


def words_of(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """The lower-case words of all texts in one row: runs of letters and marks with a letter.

    A number for each word, the distinct words, and the number of words of each text.
    """
    lists = pc.split_pattern_regex(pc.utf8_lower(column), pattern=r"[^\p{L}\p{M}]+")
    words = lists.flatten()
    some = pc.match_substring_regex(words, pattern=r"\p{L}").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = words.filter(pa.array(some)).dictionary_encode()
    counts = np.diff(np.concatenate([[0], before[ends]]))
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), counts


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bins of all n-grams of all words, one after another, and where each word's end.

    Words are framed by spaces, so that n-grams see where a word starts and ends.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    bins, owners = [], []
    rolled = np.zeros(len(chars), np.uint64)
    for n in GRAMS:
        # The hash of the n characters from here on, from that of n - 1.
        rolled = rolled[: len(chars) - n + 1] * ODD[0] + chars[n - 1 :]
        inside = word[: len(rolled)] == word[n - 1 :]
        bins.append((mixed(rolled[inside] + np.uint64(n) * ODD[2]) % np.uint64(BINS)).astype(np.int64))
        owners.append(word[: len(rolled)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(bins)[order], np.cumsum(np.bincount(owner, minlength=len(words)))


# Linear machines


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, regularisation: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Weights of a squared-hinge linear SVM, by Newton steps on the rows inside the margin.

    The last column of ``x`` is 1 for the intercept; ``y`` is -1 or 1 and ``cost`` sums to 1.
    The steps end where one lowers the loss by less than a thousandth.
    """
    w = np.zeros(x.shape[1], x.dtype)
    y, cost = y.astype(x.dtype), cost.astype(x.dtype)

    def loss(w: np.ndarray) -> float:
        return float(regularisation / 2 * (w @ w) + 0.5 * (cost * np.maximum(0, 1 - y * (x @ w)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        short = np.maximum(0, 1 - y * (x @ w))
        gradient = regularisation * w - x.T @ (cost * short * y)
        inside = short > 0
        xi, ci = x[inside], cost[inside]
        step = _conjugate(lambda v: regularisation * v + xi.T @ (ci * (xi @ v)), -gradient)
        size, then = 1.0, loss(w + step)
        while size > 1e-6 and then > now:
            size /= 2
            then = loss(w + np.asarray(size, x.dtype) * step)
        if then > now:
            break
        w = w + np.asarray(size, x.dtype) * step
        if now - then < 1e-3 * now:
            break
        now = then
    return w


def _conjugate(product, b: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Solve product(v) = b by conjugate gradients, to a hundredth of ``b``."""
    v, r = np.zeros_like(b), b.copy()
    d, rr = r.copy(), r @ r
    enough = 1e-4 * rr
    for _ in range(rounds):
        if rr <= enough:
            break
        p = product(d)
        at = rr / (d @ p)
        v, r = v + at * d, r - at * p
        rr, old = r @ r, rr
        d = r + rr / old * d
    return v


@dataclass
class Model:
    """One-versus-rest weights of families and one-versus-one weights of languages in a family.

    ``weights`` has a row for each machine, families first, then pairs as ``pairs`` lists them;
    its last column is the intercept.
    """

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row of margins and a score of 0 to 1.

        The family of the greatest margin, the first of equals; in it the language with the
        most votes of pairs, then the greatest sum of margins, then the first. The score is
        the family's share times the mean confidence of the language's pairs.
        """
        n_families = len(self.families)
        family = margins[:, :n_families].argmax(axis=1)
        sure = 1 / (1 + np.exp(-np.clip(2 * margins, -30, 30)))
        share = sure[:, :n_families] / sure[:, :n_families].sum(axis=1, keepdims=True)
        languages = np.full(len(margins), "", object)
        score = share[np.arange(len(margins)), family]
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if len(members) == 1:
                languages[rows] = members[0]
                continue
            votes, sums, means = (np.zeros((len(rows), len(members))) for _ in range(3))
            for k, (a, b) in enumerate(self.pairs, n_families):
                if a not in members:
                    continue
                m, s = margins[rows, k], sure[rows, k]
                for language, sign in ((a, 1), (b, -1)):
                    at = members.index(language)
                    votes[:, at] += sign * m >= 0 if sign > 0 else m < 0
                    sums[:, at] += sign * m
                    means[:, at] += s if sign > 0 else 1 - s
            best = np.lexsort((-sums, -votes), axis=-1)[:, 0] if len(rows) else np.zeros(0, int)
            languages[rows] = np.array(members, object)[best]
            score[rows] *= means[np.arange(len(rows)), best] / (len(members) - 1)
        return languages.tolist(), score


def _grouped(languages: list[str], profiles: dict[str, np.ndarray], families: dict[str, tuple[str, ...]]) -> list[list[str]]:
    """The learned languages by family, in order.

    A language that no family names joins that of the most similar named one, by the cosine of
    their mean features; if none is named, all are one family.
    """
    known = {code: name for name, codes in families.items() for code in codes}

    def family(language: str) -> str:
        named = [x for x in languages if x in known]
        if language in known or not named:
            return known.get(language, "")
        mine = profiles[language]
        return known[max(named, key=lambda x: mine @ profiles[x] / (np.linalg.norm(profiles[x]) or 1))]

    out: dict[str, list[str]] = {}
    for language in languages:
        out.setdefault(family(language), []).append(language)
    return [out[name] for name in sorted(out)]


def _machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A machine in which both sides weigh the same."""
    y = np.where(positive, 1.0, -1.0)
    cost = np.where(positive, 0.5 / positive.sum(), 0.5 / (~positive).sum())
    return linear_svm(x, y, cost)


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: dict[str, tuple[str, ...]] = FAMILIES, most: int = MOST_TEXTS) -> Model | None:
    """A model from the rows with a language and a letter that are not held out.

    At most ``most`` texts, of each language an equal part, those with the least hashes of their
    ids; their features are counted by the tasks from the whole texts, and the driver has
    ``BINS`` numbers of each. None without such rows.
    """
    known = df.where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull() & ~is_held_out(F.col(f"`{id_col}`"))).select(
        F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")
    )
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(FEWEST, most // len(counts))
    # A share of the hashes of each language leaves about twice as many rows as wanted, so that
    # the sort for the least ones sees a bounded number of rows of a language.
    bits = 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2.0 * each / n) * (1 << bits)))])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    some = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << bits)) < share[F.col("lang")])
    some = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).drop("n", "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, langs = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("lang"))
            codes, words, n_words = words_of(texts)
            bins, ends = word_features(words)
            ends = np.concatenate([[0], ends])
            found, at = [], 0
            for n in n_words:
                times = np.bincount(codes[at : at + n], minlength=0)
                used = np.flatnonzero(times)
                lengths = (ends[1:] - ends[:-1])[used]
                places = np.arange(lengths.sum()) + np.repeat(ends[used] - np.cumsum(lengths) + lengths, lengths)
                found.append(np.bincount(bins[places], np.repeat(times[used], lengths), BINS).astype(np.float32))
                at += n
            kept = n_words > 0
            yield pa.RecordBatch.from_arrays([langs.filter(pa.array(kept)), pa.array([(f / f.sum()).tobytes() for f, k in zip(found, kept) if k], pa.binary())], ["lang", "share"])

    found = some.mapInArrow(count, "lang string, share binary").toArrow()
    if not found.num_rows:
        return None
    # One order, however the rows come, so that a model is the same each time.
    rows = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    langs = np.array([lang for lang, _ in rows], object)
    x = np.frombuffer(b"".join(share for _, share in rows), np.float32).reshape(len(langs), BINS)
    del found, rows
    languages = sorted(set(langs))
    spread = _scale(x)
    x = np.concatenate([x * spread, np.ones((len(x), 1), np.float32)], axis=1)
    grouped = _grouped(languages, {a: x[langs == a].mean(axis=0) for a in languages}, families)
    machines, pairs = [], []
    for members in grouped:
        inside = np.isin(langs, members)
        machines.append(_machine(x, inside) if not inside.all() else np.append(np.zeros(BINS), 1.0))
    for members in grouped:
        for a, b in combinations(members, 2):
            both = (langs == a) | (langs == b)
            pairs.append((a, b))
            machines.append(_machine(x[both], langs[both] == a))
    weights = np.array(machines)
    weights[:, :-1] *= spread
    return Model(grouped, pairs, weights)


def _scale(x: np.ndarray) -> np.ndarray:
    """What brings each feature to a comparable spread; rare ones are not blown up."""
    deviation = x.std(axis=0)
    return (1 / (deviation + deviation.mean() + 1e-12) / np.sqrt(BINS)).astype(np.float32)


def add_language(df: DataFrame, model: Model | None, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``df`` with the predicted language and a score, and the names of these columns.

    Null texts and texts without a letter are ``und`` with score 0, as is all without a model.
    Whole texts count, however long; the names are free ones, if ``df`` has them already.
    """
    lang, score = free_name(df, "lang_pred"), free_name(df, "lang_score")
    place = df.columns.index(text_col)
    schema = StructType([*df.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])
    target = to_arrow_schema(schema)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        answers, sure = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
        codes, words, n_words = words_of(pc.fill_null(batch.column(place), ""))
        rows = np.flatnonzero(n_words)
        if model is not None and len(rows):
            sums, grams = np.zeros((len(words), len(model.weights))), np.zeros(len(words))
            for at in range(0, len(words), WORDS):
                bins, ends = word_features(words[at : at + WORDS])
                starts = np.concatenate([[0], ends[:-1]])
                for k, w in enumerate(model.weights):
                    sums[at : at + WORDS, k] = np.add.reduceat(w[bins], starts)
                grams[at : at + WORDS] = ends - starts
            starts = np.cumsum(n_words[rows]) - n_words[rows]
            total = np.add.reduceat(grams[codes], starts)
            margins = np.stack([np.add.reduceat(s[codes], starts) / total for s in sums.T], axis=1) + model.weights[:, -1]
            answers[rows], sure[rows] = model.decide(margins)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string()), pa.array(sure, pa.float64())], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield predict(batch)

    return df.mapInArrow(run, schema), lang, score


def predictions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score of every row; other columns are ignored, whatever their names."""
    model = learn(df, id_col, text_col, lang_col)
    found, lang, score = add_language(df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), model)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
