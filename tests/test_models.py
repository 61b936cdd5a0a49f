"""Models, clusters, series and pricing by their properties."""

import datetime as dt
import inspect

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from fixtures import by, lines
from pyspark.sql import functions as F

from tallyline.operators import clusters
from tallyline.operators import customers as cu
from tallyline.operators import models as mo
from tallyline.operators import pricing as pr
from tallyline.operators import series as se
from tallyline.operators.lines import clean_lines
from tallyline.operators.statistics import regression_metrics
from tallyline.plans import queries as registry
from tallyline.schema import LINE_KEY


def test_split_is_disjoint_complete_and_stable(ol):
    train, test = mo.train_test_split(ol)
    assert train.count() + test.count() == ol.count()
    again, _ = mo.train_test_split(ol.repartition(11))
    assert train.select(LINE_KEY).exceptAll(again.select(LINE_KEY)).count() == 0
    assert 0.77 < train.count() / ol.count() < 0.83


def test_clusters_are_complete_and_repeatable(ol):
    first = mo.customer_clusters(ol)
    assert first.select("cluster").distinct().count() == 5
    assert first.count() == cu.customer_features(ol).count()
    second = mo.customer_clusters(ol).select("customer_name", "cluster")
    assert first.select("customer_name", "cluster").exceptAll(second).count() == 0
    profile = mo.cluster_profile(first, cu.CUSTOMER_FEATURES, "clv").collect()
    assert sum(r.members for r in profile) == first.count()
    assert sum(r.percentage for r in profile) == pytest.approx(100.0, abs=0.05)
    pdf = first.toPandas()
    for r in profile:
        assert r.median_clv == pytest.approx(pdf[pdf.cluster == r.cluster].clv.median())
    best = mo.best_and_worst_cluster(mo.cluster_profile(first, cu.CUSTOMER_FEATURES), "avg_clv").first()
    assert best.high_value_cluster == max(profile, key=lambda r: r.avg_clv).cluster


def test_clusters_of_odd_tables(spark):
    schema = "k string, x double, y double"
    blobs = [(f"{g}-{i}", 10.0 * g + i % 3, 5.0 * g - i % 2) for g in range(3) for i in range(70)]
    rows = spark.createDataFrame([*blobs, ("none", None, 1.0)], schema)
    found = clusters.assign_clusters(rows.repartition(5), ["x", "y"], 3)
    assert {(r.k.split("-")[0], r.cluster) for r in found.collect()} == {("0", 0), ("1", 1), ("2", 2)}
    same = clusters.assign_clusters(spark.createDataFrame([("a", 1.0, 2.0)] * 9, schema), ["x", "y"], 3)
    assert [r.cluster for r in same.collect()] == [0] * 9
    assert clusters.assign_clusters(rows.limit(0), ["x", "y"], 3).count() == 0
    assert clusters.assign_clusters(rows.where("x IS NULL"), ["x", "y"], 3).count() == 0


def test_outliers_match_z_scores(spark):
    rows = [("a%d" % i, 0, float(i % 5), 1.0) for i in range(60)] + [("far", 0, 500.0, 1.0), ("one", 1, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, cluster int, x double, y double")
    got = mo.cluster_outliers(df, "k", ["x", "y"]).collect()
    assert [(r.k, r.x, r.y) for r in got] == [("far", 500.0, None)]


def test_linear_model_finds_a_planted_line(ol):
    planted = ol.withColumn("delivered_margin", 3.0 * F.col("line_volume_cbm") - 2.0 * F.col("line_quantity") + 1.0)
    _, coefficients, scores = mo.margin_linear_model(planted)
    got = {r.feature: r.coefficient for r in coefficients.collect()}
    assert got["line_quantity"] == pytest.approx(-2.0, abs=1e-3)
    assert scores.first().r2 > 0.999


def test_regressor_handles_unseen_levels_and_missing_values(spark, ol, tmp_path):
    numeric, categorical = ("line_quantity", "line_volume_cbm"), ("order_channel", "order_region")
    planted = ol.withColumn(
        "y", 2.0 * F.col("line_quantity") + F.when(F.col("order_channel") == "1-URGENT", 50.0).otherwise(0.0)
    )
    model = mo.fit_regressor(planted, "y", numeric, categorical, slots=64)
    scored = mo.predict(model, planted, numeric, categorical, "p")
    assert regression_metrics(scored, "y", "p").first().r2 > 0.99
    odd = planted.limit(5).withColumn("order_channel", F.lit("never seen")).withColumn("order_region", F.lit(None).cast("string"))
    odd = odd.withColumn("line_quantity", F.lit(None).cast("double"))
    assert mo.predict(model, odd, numeric, categorical, "p").filter("p is null").count() == 0
    mo.save_model(model, str(tmp_path / "model"))
    again = mo.predict(mo.load_model(str(tmp_path / "model")), planted, numeric, categorical, "p2")
    assert scored.join(again.select(LINE_KEY, "p2"), LINE_KEY).filter(F.abs(F.col("p") - F.col("p2")) > 1e-9).count() == 0


def test_segments_reach_every_line_and_survive_saving(spark, ol, tmp_path):
    predicted = ol.withColumn("p", F.col("product_margin"))
    segments = mo.customer_segments(predicted, "p")
    mo.save_map(segments, str(tmp_path / "segments"))
    mapped = mo.with_segments(ol, mo.load_map(spark, str(tmp_path / "segments")))
    assert mapped.filter("customer_segment is null or avg_predicted_margin is null").count() == 0
    assert mapped.select("customer_segment").distinct().count() == 3


def test_target_encoding_without_leak(ol):
    train, test = mo.train_test_split(ol)
    encoded = mo.target_encode(test, ["order_channel"], fit_on=train)
    want = {r[0]: r[1] for r in train.groupBy("order_channel").agg(F.avg("delivered_margin")).collect()}
    for r in encoded.select("order_channel", "order_channel_encoded").distinct().collect():
        assert r[1] == pytest.approx(want[r[0]])
    unseen = test.limit(1).withColumn("order_channel", F.lit("new"))
    overall = train.agg(F.avg("delivered_margin")).first()[0]
    assert mo.target_encode(unseen, ["order_channel"], fit_on=train).first().order_channel_encoded == pytest.approx(overall)


def test_tree_models_learn(ol):
    planted = ol.withColumn("total_revenue", 3.0 * F.col("line_product_cost"))
    _, importance, scores = mo.revenue_forest(planted, trees=10)
    rows = importance.collect()
    # Item prices hardly differ in these tables, so quantity and cost tell the same.
    assert {r.feature for r in rows[:2]} == {"line_product_cost", "line_quantity"}
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert rows == sorted(rows, key=lambda r: -r.importance)
    assert scores.first().r2 > 0.5
    _, importance, scores = mo.margin_boosted_trees(ol, rounds=5, depth=4, leak_free=True)
    assert {"customer_agreement_encoded", "line_quantity"} <= {r.feature for r in importance.collect()}
    assert scores.first().mae > 0


def test_items_that_shared_a_slot_are_apart(spark):
    rows = [(f"item{k}", float(k)) for k in range(2000)]
    df = spark.createDataFrame(rows, "item_number string, x double")
    vectors = mo.preprocessing(df, ["x"], ["item_number"]).transform(df).select("item_number_hashed").collect()
    places = {int(r[0].indices[0]) for r in vectors}
    assert len(places) > 0.96 * len(rows)
    two = spark.createDataFrame([("item0", 0.0), *((f"item{k}", 100.0) for k in range(1, 30))] * 20, "item_number string, y double")
    two = two.withColumn("x", F.rand(3))
    model = mo.fit_regressor(two, "y", ["x"], ["item_number"])
    got = dict(mo.predict(model, two, ["x"], ["item_number"], "p").groupBy("item_number").agg(F.avg("p")).collect())
    assert got["item0"] < 10 and min(v for k, v in got.items() if k != "item0") > 90


def test_cross_validation_scores(ol):
    planted = ol.withColumn("delivered_margin", 4.0 * F.col("line_quantity") + 1.0)
    _, importance, scores = mo.margin_regressor_cv(planted, folds=3, categorical=("order_channel",))
    got = scores.first()
    assert got.cv_r2_mean > 0.99 and got.r2 > 0.99 and got.cv_r2_std < 0.01
    assert importance.first().feature == "line_quantity"


# --- series -------------------------------------------------------------------


def decompose_twin(x: np.ndarray, period: int = 7) -> pd.DataFrame:
    trend = pd.Series(x).rolling(period, center=True).mean()
    left = pd.Series(x) - trend
    means = np.array([left[i::period].mean() for i in range(period)])
    means = means - np.nanmean(means)
    seasonal = np.tile(means, len(x) // period + 1)[: len(x)]
    return pd.DataFrame({"trend": trend, "seasonal": seasonal, "residual": x - trend - seasonal})


@pytest.mark.parametrize("days", [7, 20, 60])
def test_decomposition_equals_twin(spark, days):
    rng = np.random.default_rng(days)
    dates = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i * 1.2)) for i in range(days)]
    df = clean_lines(
        lines(spark, *({"order_date": d, "line_volume_cbm": float(np.round(v, 3))} for d, v in zip(dates, rng.random(days))))
    )
    got = se.seasonal_decompose(df).filter("series_key = 'line_volume_cbm'").orderBy("order_date").toPandas()
    want = decompose_twin(got.value.to_numpy())
    for c in want:
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9)


def test_decomposition_parts_add_up(ol):
    parts = se.seasonal_decompose(ol)
    off = parts.filter(F.abs(F.col("trend") + F.col("seasonal") + F.col("residual") - F.col("value")) > 1e-6)
    assert off.count() == 0
    sums = parts.select("series_key", "position", "seasonal").distinct().groupBy("series_key").agg(F.sum("seasonal").alias("s"))
    assert sums.filter(F.abs("s") > 1e-6).count() == 0


def test_forecast_follows_a_weekly_pattern(spark):
    week = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0, 70.0]
    start = dt.date(2024, 1, 1)
    rows = ({"order_date": start + dt.timedelta(days=i), "line_product_revenue": week[i % 7]} for i in range(70))
    got = se.forecast_daily(clean_lines(lines(spark, *rows))).filter("series_key = 'total_revenue'")
    got = got.orderBy("step").collect()
    assert len(got) == 30 and got[0].order_date == start + dt.timedelta(days=70)
    for i, r in enumerate(got):
        assert r.forecast == pytest.approx(week[i % 7] + 20.0, abs=1e-6)
        assert r.lower <= r.forecast <= r.upper


def test_forecast_band_widens_and_short_series_work(spark, ol):
    got = se.forecast_daily(ol).groupBy("series_key").agg(
        F.max_by(F.col("upper") - F.col("lower"), "step").alias("last"),
        F.min_by(F.col("upper") - F.col("lower"), "step").alias("first"),
    )
    assert got.filter("last < first").count() == 0
    short = clean_lines(lines(spark, {}, {"order_date": dt.date(2024, 1, 2)}))
    assert se.forecast_daily(short, steps=3).count() == 12
    assert se.forecast_daily(ol, steps=2, dims=["order_channel"]).count() == 2 * 4 * ol.select("order_channel").distinct().count()


# --- pricing ------------------------------------------------------------------


def objective(f, k, c, t: pr.Targets):
    p = k / (1 - t.product)
    freight = np.where(f > 0, (f - c) / f, -1.0)
    return (freight - t.freight) ** 2 + ((p + f - k - c) / (p + f) - t.delivered) ** 2


def test_recommended_price_beats_a_brute_search(spark, ol):
    t = pr.Targets()
    rng = np.random.default_rng(3)
    extremes = [(60.0, 10.0), (0.5, 900.0), (5000.0, 1.0), (100.0, 0.0), (1.0, 1.0)]
    extremes += list(zip(rng.uniform(1, 2000, 40), rng.uniform(0.1, 2000, 40)))
    df = lines(spark, *({"line_product_cost": float(k), "line_freight_cost": float(c)} for k, c in extremes))
    got = pr.recommend_freight_price(df).toPandas().sort_values(LINE_KEY)
    for (k, c), f in zip(extremes, got.freight_revenue):
        grid = np.concatenate([np.geomspace(0.01, 20000.0, 200_000), np.linspace(0.01, 20000.0, 200_000)])
        assert objective(f, k, c, t) <= objective(grid, k, c, t).min() + 1e-6
    start = np.maximum(got.predicted_freight_cost / (1 - t.freight), 0.01)
    ours = objective(got.freight_revenue, got.line_product_cost, got.predicted_freight_cost, t)
    assert (ours <= objective(start, got.line_product_cost, got.predicted_freight_cost, t) + 1e-12).all()
    assert pr.recommend_freight_price(lines(spark, {"line_freight_cost": None})).first().freight_revenue is None


@pytest.mark.parametrize("demand", ["power", "exp"])
@pytest.mark.parametrize("mode", ["unit", "multiplier"])
def test_best_scenario_is_the_best_row(ol, demand, mode):
    some = ol.filter(F.xxhash64(LINE_KEY) % 40 == 0)
    rows = pr.scenario_rows(some, 12, demand, mode).toPandas()
    best = pr.price_scenarios(some, 12, demand, mode).toPandas().set_index(LINE_KEY)
    assert len(rows) == 12 * len(best)
    top = rows.sort_values(["profit", "step"], ascending=[False, True]).groupby(LINE_KEY).first()
    joined = best.join(top, rsuffix="_want")
    assert np.allclose(joined.profit, joined.profit_want)
    assert (rows.new_quantity >= 1).all() and (rows.new_price >= 0.01).all()


def test_grid_covers_the_price_range(ol):
    grid = pr.price_grid(ol)
    sizes = {r["size"]: r["count"] for r in grid.groupBy("size").count().collect()}
    assert sizes == {50: 50, 100: 100, 200: 200, 500: 500}
    spread = grid.toPandas().groupby("size").profit.std()
    got = pr.price_range(ol).first()
    assert got.best_size == spread.idxmin()
    prices = pr.with_freight_price(ol).select("price").toPandas().price
    assert (got.lower_price, got.upper_price) == pytest.approx(tuple(prices.quantile([0.05, 0.95])))


def test_score_is_clipped_and_unknown_segments_count_as_one(spark, ol):
    scored = ol.select(
        LINE_KEY,
        "customer_name",
        F.month("order_date").alias("month"),
        F.lit(1.0).alias("new_price"),
        F.lit(1e9).alias("predicted_profit"),
        F.lit(1e9).alias("predicted_quantity"),
        F.lit(50.0).alias("predicted_margin"),
    )
    nobody = spark.createDataFrame([], "customer_name string, customer_segment int")
    got = pr.scenario_score(ol, scored, nobody)
    assert got.count() == ol.count()
    assert set(got.agg(F.max("score"), F.min("score")).first()) <= {10.0, -10.0}


def test_segment_multipliers_weigh_lines(ol):
    segments = cu.value_tertiles(ol).withColumnRenamed("customer_group", "customer_segment")
    got = by(pr.segment_multipliers(ol, segments), "customer_segment")
    want = ol.join(segments, "customer_name").groupBy("customer_segment").agg(F.avg("delivered_margin").alias("m")).collect()
    assert {k: pytest.approx(r.segment_multiplier) for k, r in got.items()} == {r.customer_segment: r.m for r in want}


@pytest.mark.parametrize("query", ["revenue_forest", "margin_boosted_trees", "margin_regressor_importance"])
def test_registered_models_are_the_whole_ones(spark, ol, monkeypatch, query):
    name = "margin_regressor_cv" if query == "margin_regressor_importance" else query
    calls, whole = [], inspect.signature(getattr(mo, name))

    def called(*args, **kwargs):
        calls.append(whole.bind(*args, **kwargs))
        calls[0].apply_defaults()
        return None, spark.range(1).toDF("importance"), None

    monkeypatch.setattr(mo, name, called)
    registry.all_queries()[query](spark, SF)
    given = calls[0].arguments
    expected = {
        "revenue_forest": {"trees": 100, "depth": 30},
        "margin_boosted_trees": {"rounds": 200, "depth": 20},
        "margin_regressor_cv": {"folds": 5},
    }
    assert {k: given[k] for k in expected[name]} == expected[name]
