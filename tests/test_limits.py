"""Nothing is dropped silently: lists, fields, items and paths of any number, equal digests apart."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, sanitize, snapshots
from tidemark.plans import quantiles
from tidemark.plans.ordering import Layout, use_layout
from tidemark.sources import outcomes


def test_all_list_items_are_extracted(spark):
    text = json.dumps({"a": [{"multiplier": i} for i in range(50)]})
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sanitize.extract_numeric_fields(df).count() == 50
    assert sanitize.extract_numeric_fields(df, list_items=20).count() == 20


def test_depth_is_a_parameter(spark):
    tree = {"multiplier": 2}
    for _ in range(11):
        tree = {"a": tree}
    df = spark.createDataFrame([(1, json.dumps(tree))], "doc_id long, text string")
    assert sanitize.extract_numeric_fields(df, max_depth=12).count() == 1


def test_all_items_are_candidates(spark):
    df = spark.createDataFrame([(1, [(f"{i}.5x", 10.0 * i, 0.0, 20.0, 20.0) for i in range(1, 151)])], "id int, items array<struct<text:string,x:double,y:double,w:double,h:double>>")
    size = lambda **k: snapshots.normalise_candidates(df, **k).select(F.size("candidates")).first()[0]
    assert size() == 150 and size(first_items=100) == 100


def test_all_paths_are_ranked(spark):
    shape = [(f"p{i:03d}", "number") for i in range(80)]
    df = spark.createDataFrame([("k", "u", shape)], "kind string, url string, shape array<struct<path:string,type:string>>")
    assert profile._top_paths(df, ["url"]).select(F.size("json_paths")).first()[0] == 80
    assert profile._top_paths(df, ["url"], 50).select(F.size("json_paths")).first()[0] == 50


def test_whole_numbers_have_digests_of_their_own(spark, whole):
    def digest(values):
        rows = [("s", str(i), v, f"2025-01-01 00:00:0{i}") for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "series string, outcome_id string, value string, ts string")
        df = df.withColumn("value", F.col("value").cast("decimal(38,0)")).withColumn("ts", F.col("ts").cast("timestamp"))
        row = outcomes.dataset_fingerprint(df).first().asDict()
        return tuple(sorted((k, str(v)) for k, v in row.items()))

    assert len({digest(["1", "2"]), digest(["10", "2"]), digest(["100", "2"])}) == 3


def test_many_small_series_are_no_small_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id", "id % 5000 AS series").write.parquet(path)
    df = spark.read.parquet(path)
    try:
        use_layout(spark, Layout())
        spark.conf.set("tidemark.task.rows", "100")
        assert not quantiles.fits_one_task(df)
        spark.conf.unset("tidemark.task.rows")
        assert quantiles.fits_one_task(df)
    finally:
        spark.conf.unset("tidemark.task.rows")
        use_layout(spark, None)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from tidemark.plans import lineage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.settle(Frame())


def test_a_hot_instant_is_cut_between_its_ties(spark):
    """4,000 rows at one microsecond, in slices of at most 100, give what one window gives."""
    from pyspark.sql import Window, functions as F

    from tidemark.plans import ordering

    rows = spark.range(5_000).select(
        F.when(F.col("id") % 5 == 4, "b").otherwise("a").alias("series"),
        F.timestamp_micros(F.when(F.col("id") % 5 == 4, F.col("id") * 1_000_000).otherwise(F.lit(2_500_000_000))).alias("ts"),
        F.concat(F.lit("o"), (F.col("id") * 7919 % 5_000).cast("string")).alias("outcome_id"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"),
    )
    order = ["ts", "outcome_id"]
    spark.conf.set(ordering.TASK_ROWS_CONF, "100")
    try:
        layout = ordering.measure_layout(rows, ["series"], "ts")
        assert layout.parts == 100
        ordering.use_layout(spark, layout)
        assert ordering.declared_layout(rows) == layout
        sizes = ordering._sliced(rows, ["series"], order, layout).groupBy("series", ordering.SLICE).count()
        assert sizes.agg(F.max("count")).first()[0] <= 100
        got = ordering.scan(rows, ["series"], order, sums={"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}, prev={"p": F.col("v")}, next={"q": F.col("v")}, layout=layout)
        rolled = ordering.rolling(rows, ["series"], order, 8, lambda w: {"m": F.sum("v").over(w.rowsBetween(-8, -1))}, layout)
        got, rolled = sorted(map(tuple, got.collect())), sorted(map(tuple, rolled.collect()))
    finally:
        spark.conf.unset(ordering.TASK_ROWS_CONF)
        ordering.use_layout(spark, None)
    want = ordering.scan(rows, ["series"], order, sums={"n": F.lit(1), "s": F.coalesce("v", F.lit(0))}, prev={"p": F.col("v")}, next={"q": F.col("v")}, layout=ordering.WHOLE)
    assert got == sorted(map(tuple, want.collect()))
    plain = ordering.rolling(rows, ["series"], order, 8, lambda w: {"m": F.sum("v").over(w.rowsBetween(-8, -1))}, ordering.WHOLE).select(*["series", "ts", "outcome_id", "v", "pos", "m"])
    assert [r[:6] for r in rolled] == sorted(map(tuple, plain.collect()))


def test_joins_in_time_at_a_hot_instant(spark):
    """Thousands of observations at the instant of one outcome belong to the interval that ends there."""
    from pyspark.sql import functions as F

    from tidemark.operators import temporal
    from tidemark.plans import ordering

    at = lambda s: F.timestamp_micros(F.lit(s * 1_000_000))
    outcomes = spark.range(4).select(F.lit("a").alias("series"), F.concat(F.lit("o"), "id").alias("outcome_id"), F.timestamp_micros(F.col("id") * 10_000_000).alias("ts"), F.lit(2).cast("decimal(18,6)").alias("value"))
    obs = spark.range(3_000).select(F.lit("a").alias("series"), F.concat(F.lit("x"), "id").alias("obs_id"), F.when(F.col("id") < 2_990, at(20)).otherwise(at(21)).alias("ts"))
    spark.conf.set(ordering.TASK_ROWS_CONF, "100")
    try:
        ordering.use_layout(spark, ordering.measure_layout(obs, ["series"], "ts"))
        found = temporal.assign_interval(outcomes, obs)
        got = {tuple(r) for r in found.groupBy("prev_ts", "target_ts").count().select(F.unix_micros("prev_ts"), F.unix_micros("target_ts"), "count").collect()}
    finally:
        spark.conf.unset(ordering.TASK_ROWS_CONF)
        ordering.use_layout(spark, None)
    assert got == {(10_000_000, 20_000_000, 2_990), (20_000_000, 30_000_000, 10)}


def test_trees_are_unfolded_once(spark, tmp_path):
    """Of a column of nodes Spark infers a filter on its size, which reads every tree once more; and groups without a name count nowhere."""
    rows = [("a", 1, '{"x":[{"y":1},null,{"session":1}],"d":{"e":{}}}'), ("a", 2, "5"), ("a", 3, '{"x":'), (None, 4, '{"x":1}')]
    spark.createDataFrame(rows, "series string, doc_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = sanitize.json_path_inventory(df)
    got = {(r.series, r.path, r.type, r.documents, r.parsed_documents) for r in found.collect()}
    want = [("x", "array"), ("x[]", "object"), ("x[].y", "number"), ("x[]", "null"), ("d", "object"), ("d.e", "object")]
    assert got == {("a", p, t, 1, 2) for p, t in want}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_entries") == 1
    paths = sanitize.document_paths(df)._jdf.queryExecution().optimizedPlan().toString()
    assert paths.count("map_entries") == 1


def test_byte_histograms_make_no_objects_of_rows(spark):
    rows = [(1, "aab"), (2, ""), (3, None), (4, "é")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.h for r in df.select("id", sanitize._histogram(df, "text").alias("h")).collect()}
    assert (got[1][97], got[1][98], sum(got[1])) == (2, 1, 3) and sum(got[2]) == sum(got[3]) == 0
    assert got[4][0xC3] == got[4][0xA9] == 1
    plan = sanitize.byte_profile(df, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and sanitize.byte_histogram.evalType == 250
