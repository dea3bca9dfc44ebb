"""Language ID, hard negatives and centroids against brute force, and on awkward tables."""

import hashlib
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parent))
from conftest import LONG  # noqa: E402

from tidemark.llm import centroids, hard_negatives, language_id

VECTORS = "vec_id long, embedding array<double>, label int, id long, cluster string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", "y") for i, v, label in rows], VECTORS)


# Centroids


@given(st.integers(1, 9), st.integers(0, 40), st.integers(1, 4), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_walks_end_at_the_nearest_centroid(k, n, size, seed):
    random = np.random.default_rng(seed)
    c, x = random.integers(-3, 4, (k, size)), random.integers(-4, 5, (n, size))
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    best, dist = centroids.Orchard(c).nearest(x)
    assert best.tolist() == d.argmin(axis=1).tolist() and dist.tolist() == d.min(axis=1).tolist()


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds if c else 0):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            c[j] = [sum(col) // len(members) for col in zip(*members)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept] if c else []
    return sorted(((-1 if i is None else i), j, d, sum(e for _, q, e in found if q == j), sum(e for *_, e in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found)


def test_clusters(spark):
    random = np.random.default_rng(5)
    rows = [(n, random.normal(size=3).round(2).tolist(), 0) for n in range(60)] + [(5, [0.5, 0.5, 0.5], 1), (5, [0.5, 0.5, 0.5], 1)]
    rows += [(n, [1.0, -1.0, 0.25], 0) for n in range(100, 130)]
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [float("nan"), 0.0, 0.0], 1), (203, [float("inf"), 0.0, 0.0], 1), (204, [1.0], 1), (205, [], None), (None, [0.1, 0.2, 0.3], None)]
    got = centroids.cluster(table(spark, rows), k=5, rounds=4, size=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got.collect()) == brute_clusters(rows, 5, 4, 3)


def test_fewer_vectors_than_clusters(spark):
    rows = [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]
    assert sorted(map(tuple, centroids.cluster(table(spark, rows), size=2).collect())) == brute_clusters(rows, 8, 10, 2)
    assert centroids.cluster(table(spark, rows).limit(0), size=2).collect() == []
    assert centroids.cluster(table(spark, [(None, [1.0, 2.0], 0)]), size=2).collect() == []


def test_components_too_large_to_cluster_raise(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(table(spark, [(1, [1e30, 0.0], 0)]), size=2).collect()


# Hard negatives


def brute_negatives(rows, every, positives, negatives):
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, label, v) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, (j, other, w) in enumerate(kept) if m != n)
        for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("size, step", [(1, 0.5), (5, 0.25), (20, 0.1)])
@pytest.mark.parametrize("block_bytes", [1_500, 1 << 20])
def test_negatives(spark, size, step, block_bytes):
    random = np.random.default_rng(size)
    rows = [(int(n), (random.integers(-4, 9, size) * step).tolist(), int(random.integers(0, 3))) for n in range(-40, 120)]
    rows += [(n, [step] * size, 1) for n in range(200, 240)] + [rows[0], rows[0], (7, [step] * size, 2), (7, [0.0] * size, 2)]
    rows += [(300, None, 1), (301, [None] * size, 1), (302, [float("nan")] * size, 1), (303, [float("-inf")] * size, 1), (304, [step] * size, None), (None, [step] * size, 1), (310, [], 1), (320, [step], 1)]
    got = hard_negatives.mine(table(spark, rows), every=10, block_bytes=block_bytes)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 10, 5, 3)


def test_no_rows_and_no_positives(spark):
    some = table(spark, [(0, [1.0], 1), (1, [1.0], 2)])
    assert hard_negatives.mine(some).collect() == [] and hard_negatives.mine(some.limit(0)).collect() == []
    assert hard_negatives.mine(table(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])).collect() != []


def test_bounds_hold_and_tighten():
    random = np.random.default_rng(1)
    a, b = random.integers(-300, 300, (30, 37)), random.integers(-300, 300, (40, 37))
    sa, sb, at, exact, before = hard_negatives.summaries(a), hard_negatives.summaries(b), 0, a @ b.T, np.inf
    for starts in hard_negatives.levels(37):
        n = len(starts)
        middle, width = sa[:, at : at + n] @ sb[:, at : at + n].T, sa[:, at + n : at + 2 * n] @ sb[:, at + n : at + 2 * n].T
        assert (np.abs(exact - middle) <= width + 1e-6).all() and width.mean() < before
        before, at = width.mean(), at + 2 * n


def test_segments_are_refined_before_scoring(monkeypatch):
    """Vectors that lie in two directions: the first levels leave few pairs to score."""
    random = np.random.default_rng(2)
    base = np.repeat([[400] * 32 + [-400] * 32, [-400] * 32 + [400] * 32], 500, axis=0)
    q = (base + random.integers(-20, 20, base.shape)).astype(np.int32)
    columns = [pa.array(np.arange(1000)), pa.array(np.arange(1000)), pa.array(np.arange(1000) % 3), hard_negatives._packed(q), hard_negatives._packed(hard_negatives.summaries(q))]
    rows = hard_negatives.Vectors(columns)
    monkeypatch.setattr(hard_negatives, "_exact", lambda *_: pytest.fail("scored all pairs"))
    high = np.full(1000, np.inf)
    low = (q.astype(np.int64) ** 2).sum(axis=1) * 1.05
    a, r, score = hard_negatives.candidates(rows, rows, np.ones((1000, 1000), bool), low, high)
    every = q.astype(np.int64) @ q.astype(np.int64).T
    assert len(a) == (every >= low[:, None]).sum() and (every[a, r] == score).all()


def test_scores_beyond_doubles_are_exact(spark):
    v = [2.0**17 + 3 / 256, 2.0**17 + 1 / 256] * 8
    rows = [(0, v, 1), (1, v, 1), (2, [x * 0.75 for x in v], 2), (3, [x * 0.75 - 1 / 256 for x in v], 2)]
    assert sorted(map(tuple, hard_negatives.mine(table(spark, rows)).collect())) == brute_negatives(rows, 50, 5, 3) != []


# Languages

SAMPLES = {
    "en": "the people of this country think that they should have been there with their friends when it was raining",
    "de": "die menschen in diesem land glauben dass sie mit ihren freunden dort sein sollten als es geregnet hat",
    "fr": "les gens de ce pays pensent que vous devriez aussi être là avec leurs amis quand il pleuvait beaucoup",
    "es": "la gente de este país piensa que también deberían haber estado allí con sus amigos cuando llovía mucho",
}


@pytest.fixture(scope="module")
def spoken(spark):
    random = np.random.default_rng(3)
    rows = []
    for n in range(400):
        lang = sorted(SAMPLES)[n % 4]
        words = random.choice(SAMPLES[lang].split(), random.integers(4, 30))
        rows.append((n, " ".join(words).upper() if n % 5 == 0 else " ".join(words), lang, "s", n, "x", "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string")


def test_held_out_languages(spark, spoken):
    got = {r.doc_id: r for r in language_id.predictions(spoken).collect()}
    rows = [(r.lang, got[r.doc_id].lang_pred) for r in spoken.collect() if got[r.doc_id].held_out]
    assert len(rows) > 60 and sum(a == b for a, b in rows) >= 0.97 * len(rows)
    model = language_id.learn(spoken)
    assert model.families == [["de", "en"], ["es", "fr"]] and model.pairs == [("de", "en"), ("es", "fr")]


def test_unnamed_languages_join_the_most_similar_family(spark, spoken):
    model = language_id.learn(spoken, families={"a": ("en",), "b": ("fr",)})
    assert sorted(map(sorted, model.families)) == [["de", "en"], ["es", "fr"]]
    assert language_id.learn(spoken, families={}).families == [["de", "en", "es", "fr"]]
    found, lang, _ = language_id.add_language(spoken, language_id.learn(spoken, families={}))
    rows = found.select("lang", lang).collect()
    assert lang == "_lang_pred" and sum(r[0] == r[1] for r in rows) >= 0.97 * len(rows)


def test_other_columns_are_never_inputs(spark, spoken):
    model = language_id.learn(spoken)
    plain = language_id.add_language(spoken.select("doc_id", "text"), model)[0].collect()
    other = language_id.add_language(spoken.selectExpr("-doc_id as doc_id", "text", "'xx' as lang", "'z' as source"), model)[0].collect()
    assert sorted((r.doc_id, r.lang_pred, r.lang_score) for r in plain) == sorted((-r.doc_id, r.lang_pred, r.lang_score) for r in other)


def test_features_of_words_add_up():
    words = ["a", "naïve", "日本", "😀x", "straße"]
    bins, ends = language_id.word_features(words)
    for k, w in enumerate(words):
        alone, _ = language_id.word_features([w])
        assert sorted(alone) == sorted(bins[(ends[k - 1] if k else 0) : ends[k]])
        assert len(alone) == sum(max(0, len(w) + 2 - n + 1) for n in language_id.GRAMS)


def test_awkward_texts(spark, awkward, nothing, spoken):
    model = language_id.learn(spoken)
    found, lang, score = language_id.add_language(awkward, model)
    rows = found.collect()
    assert found.columns == [*awkward.columns, "lang_pred", "lang_score"] and len(rows) == awkward.count()
    for r in rows:
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r[lang] != "und") == lettered and 0 <= r[score] <= 1
    assert {r[lang] for r in rows if r.text and r.text.startswith("The quick")} == {"en"}
    assert language_id.add_language(nothing, model)[0].collect() == [] and language_id.predictions(nothing).collect() == []
    assert language_id.learn(nothing) is None
    assert {r.lang_pred for r in language_id.predictions(awkward.where("lang is null")).collect()} == {"und"}
    assert language_id.predictions(awkward).count() == awkward.count()


def test_a_whole_text_counts(spark, spoken):
    """A text whose last part is much longer than its first is of the last one's language."""
    model = language_id.learn(spoken)
    mixed = SAMPLES["en"] + " " + (SAMPLES["es"] + ". ") * 2_000
    some = spark.createDataFrame([(1, mixed), (2, LONG), (3, "1234 !!"), (4, "ʹ́")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.add_language(some, model)[0].collect()}
    assert got[1] == "es" and got[3] == "und"
