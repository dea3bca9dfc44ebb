"""Model kernels against direct fits in plain numpy, whole and cut into blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate, logistic, online, ridge
from tidemark.plans.ordering import WHOLE, Layout
from test_values import series_of

pytestmark = pytest.mark.usefixtures("whole")
RNG = np.random.default_rng(7)
LAYOUTS = [WHOLE, Layout(slice_us=20_000_000, block_rows=25)]


def direct_ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda r: y.mean() + ((r - mean) / scale) @ beta


@pytest.mark.parametrize("layout", LAYOUTS)
def test_batched_ridge_equals_refits(spark, layout):
    x, y = RNG.normal(size=(90, 4)), RNG.normal(size=90)
    x[:, 2] = 0.7  # a constant column
    df = spark.createDataFrame(
        [("s", i, x[i].tolist(), float(y[i])) for i in range(90)], "series string, pos bigint, x array<double>, y double"
    )
    got = {r.pos: r.predicted for r in ridge.batched_ridge(df, 1.0, 10, layout).collect()}
    assert len(got) == 90 and got[5] is None
    for i in (10, 33, 89):
        assert got[i] == pytest.approx(direct_ridge(x[:i], y[:i], 1.0)(x[i]), abs=1e-9)


def direct_point(values):
    """The forecast after ``values``, written down step by step."""
    logs = [math.log(min(v, 1000.0)) for v in values]

    def row(i):
        near, far, nv, fv = logs[i - 8 : i], logs[i - 20 : i], values[i - 8 : i], values[i - 20 : i]
        out = [logs[i - k] for k in range(1, 6)]
        out += [np.mean(near), np.mean(far), np.mean(near) - np.mean(far), np.std(near), np.std(far)]
        for t in (1.5, 2.0, 5.0):
            out += [np.mean([v >= t for v in nv]), np.mean([v >= t for v in fv])]
        return out

    def smooth(i):
        level = logs[i - 20]
        for v in logs[i - 19 : i]:
            level = 2 / 9 * v + 7 / 9 * level
        return level

    n = len(values)
    at = list(range(20, n))
    x, y = np.array([row(i) for i in at]), np.array([logs[i] for i in at])
    v = min(8, len(at) - 3)
    guesses, final = {}, {}
    for a in (0.1, 1.0, 10.0):
        guesses[f"ridge_{a:g}"] = direct_ridge(x[:-v], y[:-v], a)(x[-v:])
        final[f"ridge_{a:g}"] = float(direct_ridge(x, y, a)(np.array(row(n))))
    guesses["recent_median"] = np.array([np.median(logs[i - 8 : i]) for i in at[-v:]])
    final["recent_median"] = float(np.median(logs[n - 8 :]))
    guesses["ewma"] = np.array([smooth(i) for i in at[-v:]])
    final["ewma"] = smooth(n)
    ranked = sorted((np.abs(g - y[-v:]).mean(), name) for name, g in guesses.items())[:3]
    weight = np.array([1 / max(e, 1e-6) for e, _ in ranked])
    blend = float(weight / weight.sum() @ [final[name] for _, name in ranked])
    radius = float(np.quantile(np.abs(guesses[ranked[0][1]] - y[-v:]), 0.8))
    return [round(max(1.0, min(1000.0, math.exp(blend + r))), 2) for r in (0, -radius, radius)]


VALUES = [round(1 + float(v), 2) for v in RNG.exponential(3, size=120)]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_point_forecast_equals_the_written_out_one(spark, layout):
    rows = {r.pos: r for r in ridge.point_forecast(series_of(spark, VALUES), layout=layout).collect()}
    assert rows[25].status == "INSUFFICIENT_TRAINING_ROWS" and rows[26].status == "READY"
    for i in (26, 30, 50, 77, 119):
        assert [rows[i].predicted, rows[i].lower, rows[i].upper] == pytest.approx(direct_point(VALUES[:i]), abs=0.011)
    report = evaluate.walk_forward_point(series_of(spark, VALUES)).first()
    assert (report.evaluated_targets, report.status) == (94, "COMPLETE")


def direct_rls(x, hits, factor, reg):
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    p, w, out = np.eye(x.shape[1]) / reg, np.zeros(x.shape[1]), []
    w[0] = 0.5
    for row, hit in zip(x, hits):
        out.append(min(0.999, max(0.001, float(w @ row))))
        reach = p @ row
        gain = reach / (factor + row @ reach)
        w = w + gain * (hit - w @ row)
        p = (p - np.outer(gain, row @ p)) / factor
    return out


@pytest.mark.parametrize("layout", LAYOUTS)
def test_online_rls_equals_a_plain_loop(spark, layout):
    x = RNG.normal(size=(80, 3))
    hits = (RNG.random(size=(80, 2)) < 0.4).astype(int)
    df = spark.createDataFrame(
        [("s", "m", i, x[i].tolist(), hits[i].tolist()) for i in range(80)],
        "series string, mode string, pos bigint, x array<double>, hits array<int>",
    )
    rows = online.online_rls(df, (0.95, 1.0), layout=layout).collect()
    assert len(rows) == 160
    for k in range(2):
        for factor in (0.95, 1.0):
            got = [r.probabilities[k] for r in sorted(rows, key=lambda r: r.pos) if r.factor == factor]
            assert got == pytest.approx(direct_rls(x, hits[:, k], factor, 10.0), abs=1e-8)


def test_logistic_fit_is_the_minimum():
    x, c = RNG.normal(size=(200, 3)), 0.3
    y = (RNG.random(200) < 1 / (1 + np.exp(-x[:, 0]))).astype(float)
    x[:, 1] = 0.25  # a constant column
    fit = logistic.fit_logistic(x, y, c)
    scale = np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)
    z = (x - x.mean(axis=0)) / scale
    p = fit.probability(x)
    gradient = c * z.T @ (p - y) + fit.w[1:]
    assert np.abs(gradient).max() < 1e-6 and abs((p - y).sum()) < 1e-6 and fit.w[2] == 0


@pytest.mark.parametrize("n, size", [(1, 64), (63, 64), (64, 64), (65, 128), (3000, 256), (70_000, 65_536)])
def test_sums_do_not_depend_on_the_cut(n, size):
    x, y = RNG.normal(size=(n, 3)), (RNG.random((n, 2)) < 0.4).astype(float)
    whole = logistic.Rows(np.arange(n), x, y, RNG.random((n, 2)))
    ask = logistic.Moments([(0, n), (n // 3, n)], x[0])
    cut = [logistic.Rows(*(a[at : at + size] for a in (whole.rank, whole.x, whole.hits, whole.prior))) for at in range(0, n, size)]
    got = logistic.tree_sum(np.stack([logistic.answer(part, ask) for part in cut]))
    assert got.tobytes() == logistic.answer(whole, ask).tobytes()
    assert ask.read(got, 3, 2)[1]["hits"] == pytest.approx(y[n // 3 :].sum(axis=0))


def test_experiment_of_plain_fits(spark):
    values = [round(1 + float(v), 2) for v in RNG.exponential(3, size=160)]
    got = {r.threshold: r for r in logistic.logistic_experiment(series_of(spark, values)).collect()}
    logs, hit = np.log(np.minimum(values, 1000)), lambda t, v: float(v >= t)
    x = [[logs[i - k] for k in range(1, 6)] + [logs[i - 20 : i].mean()] + [np.mean([hit(t, v) for v in values[i - 20 : i]]) for t in (1.5, 2, 5)] for i in range(20, 160)]
    x, n = np.array(x), 140
    test, val = n - int(n * 0.2), n - 2 * int(n * 0.2)
    for t in (1.5, 2.0, 5.0):
        y = np.array([hit(t, v) for v in values[20:]])
        fits = {c: logistic.fit_logistic(x[:val], y[:val], c) for c in (0.1, 1.0, 10.0)}
        score = {c: np.mean((f.probability(x[val:test]) - y[val:test]) ** 2) for c, f in fits.items()}
        best = min(score, key=lambda c: (score[c], c))
        final = logistic.fit_logistic(x[:test], y[:test], best)
        assert (got[t].status, got[t].selected_c, got[t].train_rows, got[t].test_rows) == ("COMPLETE", best, val, n - test)
        assert got[t].validation_brier == pytest.approx(score[best], abs=1e-10)
        assert got[t].test_brier == pytest.approx(np.mean((final.probability(x[test:]) - y[test:]) ** 2), abs=1e-10)
        assert 1 / (1 + np.exp(-got[t].intercept - x @ np.array(got[t].weights))) == pytest.approx(final.probability(x), abs=1e-9)


@pytest.mark.parametrize("operator", [logistic.logistic_experiment, logistic.gated_logistic_forecast])
def test_series_in_rounds_have_the_same_rows(spark, monkeypatch, operator):
    from tidemark.plans import ordering

    frames = [series_of(spark, [round(1 + float(v), 2) for v in RNG.exponential(3, size=n)]).drop("series").selectExpr(f"'s{n}' as series", "*") for n in (30, 190)]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    whole = sorted(map(tuple, operator(rows).collect()))
    ordering.use_layout(spark, None)
    spark.conf.set(ordering.TASK_ROWS_CONF, "100")
    monkeypatch.setattr(logistic, "FOLD", 4)
    try:
        cut = operator(rows)
        assert "mapInPandas" in cut._jdf.queryExecution().toString() or "MapInPandas" in cut._jdf.queryExecution().toString()
        cut = sorted(map(tuple, cut.collect()))
    finally:
        spark.conf.unset(ordering.TASK_ROWS_CONF)
        ordering.use_layout(spark, ordering.WHOLE)
    assert repr(cut) == repr(whole) and len(whole) == 6


def test_challenger_reasons(spark):
    report = {r.threshold: r for r in logistic.gated_logistic_forecast(series_of(spark, VALUES)).collect()}
    assert {r.reason for r in report.values()} == {"insufficient_challenger_history"}
    assert report[2.0].probability == report[2.0].baseline_probability
    longer = [round(1 + float(v), 2) for v in RNG.exponential(3, size=200)]
    rows = logistic.gated_logistic_forecast(series_of(spark, longer)).orderBy("threshold").collect()
    assert all(r.reason.startswith("chronological_gate") for r in rows)
    assert [r.probability for r in rows] == sorted((r.probability for r in rows), reverse=True)


def samples_of(spark, signal, n=120):
    rows = []
    for i in range(n):
        value = 4.0 if RNG.random() < 0.5 else 1.0
        told = (value - 2) if signal else float(RNG.normal())
        rows.append(("s", f"o{i}", i + 20, value, 2.0, [float(RNG.normal())] * 2, [told, 1.0]))
    return spark.createDataFrame(
        rows, "series string, outcome_id string, target_index bigint, actual double, baseline double, "
        "history array<double>, state array<double>",
    )


def test_planted_state_signal_wins_and_noise_does_not(spark):
    row = evaluate.prequential_adaptive_audit(samples_of(spark, True), ("2",)).first()
    assert row.champion_skill_vs_baseline_pct > 50 and float(row.state_or_hybrid_selection_rate) > 0.9
    state = evaluate.walk_forward_state(samples_of(spark, True)).first()
    assert state.hybrid_improvement_pct > 50 and state.evaluated_targets == 80
    noise = evaluate.prequential_adaptive_audit(samples_of(spark, False), ("2",)).first()
    assert noise.champion_skill_vs_baseline_pct < 20


def test_state_ridge_equals_direct_fits(spark):
    df = samples_of(spark, False, 60)
    rows = sorted(df.collect(), key=lambda r: r.target_index)
    x = np.array([r.state for r in rows])
    y = np.array([math.log(r.actual) for r in rows])
    for layout in (WHOLE, Layout(slice_us=None, block_rows=30)):
        got = {r.pos: r.state_log for r in evaluate.state_predictions(df, layout=layout).collect()}
        for i in (40, 59):
            v = min(12, max(3, i // 4))
            losses = [
                (np.abs(direct_ridge(x[: i - v], y[: i - v], a)(x[i - v : i]) - y[i - v : i]).mean(), a)
                for a in (1.0, 10.0, 100.0)
            ]
            assert got[i] == pytest.approx(float(direct_ridge(x[:i], y[:i], min(losses)[1])(x[i])), abs=1e-9)


@pytest.mark.parametrize("query", ["online_rls", "champion_selection", "prequential_adaptive_audit", "prospective_feature_audit"])
def test_online_queries_are_equal_whatever_a_task_holds(spark, query):
    import os

    from compare import spark_table

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables not present")
    tables = []
    for rows in (None, "40", "60"):
        if rows:
            spark.conf.set("tidemark.task.rows", rows)
        try:
            tables.append(spark_table(entry.queries()[query](spark, folder)))
        finally:
            spark.conf.unset("tidemark.task.rows")
    assert tables[0] == tables[1] == tables[2]


def test_online_rls_is_well_posed_without_excitement(spark):
    rng = np.random.default_rng(3)
    x = np.zeros((900, 4))
    x[:, 0] = rng.normal(size=900)
    x[:300, 1] = rng.normal(size=300)  # moves no more after the first third
    x[:, 2] = 0.25
    hits = rng.integers(0, 2, (900, 1))
    df = spark.createDataFrame(
        [("s", "m", i, [float(v) for v in x[i]], [int(hits[i, 0])]) for i in range(900)],
        "series string, mode string, pos bigint, x array<double>, hits array<int>",
    )
    made = [
        {(r.factor, r.pos): r.probabilities[0] for r in online.online_rls(df, (0.9, 1.0), layout=layout).collect()}
        for layout in (Layout(), Layout(block_rows=64), Layout(block_rows=150))
    ]
    assert made[0] == made[1] == made[2]
    late = [p for (f, i), p in made[0].items() if f == 0.9 and i > 500]
    assert np.std(late) < 0.45 and not all(p in (0.001, 0.999) for p in late)


def test_blocks_of_a_kernel_are_small_whatever_a_task_holds(spark, monkeypatch):
    """A layout of whole series cuts pandas kernels all the same, with the same bits; states of online models stream."""
    from tidemark.operators import blocks
    from tidemark.plans.ordering import Layout

    df = spark.range(700).selectExpr(
        "'s' AS series", "'m' AS mode", "id AS pos", "array(sin(id), cos(id * id)) AS x", "array(int(id % 3 = 0)) AS hits", "sin(id * 7) AS y"
    )
    ask = lambda: {(r.factor, r.pos): r.probabilities[0] for r in online.online_rls(df, (0.9, 1.0), layout=Layout()).collect()}
    whole, ridges = ask(), {r.pos: r.predicted for r in ridge.batched_ridge(df, 1.0, 10, Layout()).collect()}
    monkeypatch.setattr(blocks, "KERNEL_ROWS", 100)
    seen = online.online_rls(df, (0.9, 1.0), layout=Layout())
    assert "MapInPandas" in seen._jdf.queryExecution().executedPlan().toString()
    assert ask() == whole
    cut = {r.pos: r.predicted for r in ridge.batched_ridge(df, 1.0, 10, Layout()).collect()}
    assert cut[5] is None and all(cut[i] == pytest.approx(ridges[i], abs=1e-9) for i in range(10, 700))
