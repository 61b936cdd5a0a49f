"""Aggregates, windows and joins on edge rows, against short pandas twins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from fixtures import by, lines
from pyspark.sql import functions as F

from tallyline.operators import agreements as ag
from tallyline.operators import channels as ch
from tallyline.operators import customers as cu
from tallyline.operators import dashboard as da
from tallyline.operators import drilldown as dr
from tallyline.operators import elasticity as el
from tallyline.operators import freight as fr
from tallyline.operators import inventory as inv
from tallyline.operators import pricing as pr
from tallyline.operators import products as po
from tallyline.operators import profile as pf
from tallyline.operators import statistics as st
from tallyline.operators.lines import clean_lines, enriched_lines, with_margins, with_totals
from tallyline.plans.queries import all_queries
from tallyline.schema import LINE_KEY
from tallyline.sources import drilldown as ds


def raw(spark, *rows):
    """Enriched but not cleaned lines, so missing values reach the operators."""
    df = with_totals(with_margins(lines(spark, *rows)))
    return df.withColumn("avg_price", F.try_divide("line_product_revenue", "line_quantity"))


def test_null_keys_are_dropped(spark):
    df = raw(spark, {"order_region": None, "order_channel": None, "customer_agreement": None, "item_number": None}, {})
    for table in (
        ch.region_channel(df),
        ag.agreement_analysis(df),
        po.product_performance(df),
        inv.profitability_by(df, "order_region"),
        pf.order_line_counts(df).filter("category_column = 'category_1'"),
    ):
        assert table.count() == 1


def test_sum_of_missing_is_zero_and_mean_skips_missing(spark):
    df = raw(spark, {"item_number": "gone", "line_product_revenue": None}, {}, {"line_product_cost": None})
    table = by(po.product_performance(df), "item_number")
    assert table["gone"].line_product_revenue == 0.0
    assert table["gone"].product_margin == 0.0
    margins = by(dr.mean_margin_by(df, "item_number"), "item_number")
    assert margins["i1"].avg_delivered_margin == pytest.approx((120 - 70) / 120 * 100)
    assert margins["gone"].avg_delivered_margin is None


def test_single_line_groups(spark):
    df = clean_lines(lines(spark, {"customer_agreement": "solo"}, {}, {"line_product_revenue": 150.0}))
    spread = by(ag.pricing_variation(df), "customer_agreement")
    assert "solo" not in spread and "a1" in spread
    only = po.price_variance(clean_lines(lines(spark, {}))).first()
    assert only.price_variance == 0.0


def test_describe_matches_pandas(spark, ol):
    pdf = ol.select(*pf.KEY_METRICS).toPandas()
    got = by(pf.describe(ol, pf.KEY_METRICS), "metric")
    for m in pf.KEY_METRICS:
        want = pdf[m].describe()
        names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "25%": "p25", "50%": "p50", "75%": "p75", "max": "max"}
        for theirs, ours in names.items():
            assert got[m][ours] == pytest.approx(want[theirs], rel=1e-9)


def test_top_k_ties_go_to_the_smaller_key(spark):
    df = clean_lines(lines(spark, *({"item_number": i} for i in "dcba")))
    assert [r.item_number for r in po.top_products(df, 2).collect()] == ["a", "b"]
    assert [r.item_number for r in po.bottom_products(df, 2).collect()] == ["a", "b"]


def test_contributions_sum_to_hundred(ol):
    total = po.product_contributions(ol).agg(F.sum("profit_contribution"), F.sum("revenue_contribution")).first()
    assert total[0] == pytest.approx(100.0) and total[1] == pytest.approx(100.0)


def test_lifetime_value_is_clipped_revenue(spark, ol):
    wrong = cu.customer_features(ol).filter(
        F.abs(F.col("clv") - F.greatest(F.lit(0.0), F.col("total_product_revenue") + F.col("total_freight_revenue")))
        > 1e-6 * F.abs("clv") + 1e-9
    )
    assert wrong.count() == 0
    refund = clean_lines(lines(spark, {"line_product_revenue": -500.0}))
    assert cu.customer_features(refund).first().clv == 0.0


def test_tertile_edges_are_over_lines(spark):
    rows = [{"customer_name": "big"}] * 6 + [{"customer_name": f"s{i}"} for i in range(3)]
    df = clean_lines(lines(spark, *rows))
    got = by(cu.value_tertiles(df), "customer_name")
    values = np.repeat([6 * 120.0, 120.0], [6, 3])
    edges = np.quantile(values, [1 / 3, 2 / 3])
    for r in got.values():
        want = "Low Value" if r.customer_total_value <= edges[0] else (
            "Medium Value" if r.customer_total_value <= edges[1] else "High Value")
        assert r.customer_group == want


def test_group_channel_agrees_with_line_level_work(ol):
    tertiles = cu.value_tertiles(ol)
    want = (
        ol.join(tertiles, "customer_name")
        .groupBy("customer_group", "order_channel")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("total_revenue").alias("v"), F.avg("delivered_margin").alias("m"))
    )
    joined = cu.customer_group_channel(ol).join(want, ["customer_group", "order_channel"]).collect()
    assert len(joined) == want.count()
    for r in joined:
        assert (r.order_count, r.avg_order_value, r.avg_delivered_margin) == pytest.approx((r.n, r.v, r.m))


@pytest.mark.parametrize("split_rows", [15, None])
def test_rolling_mean_with_a_hot_customer(ol, split_rows):
    hot = ol.withColumn("customer_name", F.when(F.xxhash64(LINE_KEY) % 3 == 0, "hot").otherwise(F.col("customer_name")))
    got = cu.rolling_7(hot, split_rows=split_rows).toPandas().set_index(LINE_KEY)
    pdf = hot.select(LINE_KEY, "customer_name", "order_date", "line_product_revenue").toPandas()
    pdf = pdf.sort_values(["order_date", LINE_KEY])
    pdf["want"] = pdf.groupby("customer_name").line_product_revenue.transform(lambda s: s.rolling(7, min_periods=1).mean())
    want = pdf.set_index(LINE_KEY).want
    assert len(got) == len(want)
    assert np.allclose(got.avg_line_product_revenue_7d.reindex(want.index), want)


def elasticity_twin(pdf: pd.DataFrame, numerator: str) -> dict:
    out = {}
    for item, part in pdf.groupby("item_number"):
        ladder = part.assign(price=part[numerator] / part.line_quantity).groupby("price").line_quantity.sum()
        price = pd.Series(ladder.index).pct_change()
        quantity = pd.Series(ladder.to_numpy()).pct_change()
        keep = (price != 0) & (quantity != 0) & ~np.isinf(price) & ~np.isinf(quantity)
        value = (-quantity[keep] / price[keep]).median()
        if not np.isnan(value):
            out[item] = value
    return out


@pytest.mark.parametrize("split_rows", [10, None])
@pytest.mark.parametrize("numerator", ["line_product_revenue", "line_freight_revenue"])
def test_elasticity_with_a_hot_item(ol, numerator, split_rows):
    hot = ol.withColumn("item_number", F.when(F.xxhash64(LINE_KEY) % 3 == 0, "hot").otherwise(F.col("item_number")))
    want = elasticity_twin(hot.select("item_number", numerator, "line_quantity").toPandas(), numerator)
    got = el.neighbour_elasticity(hot, numerator, "e", split_rows).collect()
    assert {r.item_number: pytest.approx(r.e, rel=1e-9, abs=1e-12) for r in got} == want


def test_flat_and_free_prices_are_skipped(spark):
    flat = [{"item_number": "flat", "line_quantity": 1.0}, {"item_number": "flat", "line_quantity": 1.0}]
    same_quantity = [
        {"item_number": "same", "line_quantity": 1.0, "line_product_revenue": 10.0},
        {"item_number": "same", "line_quantity": 1.0, "line_product_revenue": 20.0},
    ]
    free = [
        {"item_number": "free", "line_quantity": 1.0, "line_product_revenue": 0.0},
        {"item_number": "free", "line_quantity": 2.0, "line_product_revenue": 20.0},
        {"item_number": "free", "line_quantity": 1.0, "line_product_revenue": 20.0},
    ]
    got = by(el.price_elasticity(clean_lines(lines(spark, *flat, *same_quantity, *free))), "item_number")
    assert set(got) == {"free"}
    # 10 -> 20 doubles the price, 2 -> 1 halves the quantity
    assert got["free"].price_elasticity == pytest.approx(0.5)


def test_renegotiation_uses_average_ranks(spark):
    rows = [
        {"customer_agreement": "a", "line_product_revenue": 900.0, "line_product_cost": 890.0},
        {"customer_agreement": "b", "line_product_revenue": 100.0},
        {"customer_agreement": "c", "line_product_revenue": 100.0},
        {"customer_agreement": "d", "line_product_revenue": 50.0, "line_product_cost": 10.0},
    ]
    got = by(ag.renegotiation_candidates(clean_lines(lines(spark, *rows)), 4), "customer_agreement")
    assert (got["a"].revenue_rank, got["b"].revenue_rank, got["c"].revenue_rank) == (1.0, 2.5, 2.5)
    assert min(got, key=lambda k: got[k].renegotiation_score) == "a"


@pytest.mark.parametrize("split_rows", [3, None])
def test_renegotiation_does_not_depend_on_cuts(ol, split_rows):
    whole = ag.renegotiation_candidates(ol).collect()
    assert ag.renegotiation_candidates(ol, split_rows=split_rows).collect() == whole


def test_zero_volume_orders_cost_nothing_per_cbm(spark):
    df = clean_lines(
        lines(spark, {"order_number": "z", "line_volume_cbm": 0.0}, {"order_number": "n", "line_volume_cbm": -1.0}, {})
    )
    got = by(fr.order_summary(df), "order_number")
    assert (got["z"].freight_cost_per_cbm, got["n"].freight_cost_per_cbm) == (0.0, 0.0)
    assert got["o1"].freight_cost_per_cbm == 20.0


def test_order_region_is_that_of_the_smallest_line_key(spark):
    df = clean_lines(lines(spark, {"order_region": "south"}, {"order_region": "north"}))
    assert fr.order_summary(df).first().order_region == "south"


def test_mixed_order_keeps_both_lines(spark):
    rows = [
        {"order_number": "m", "line_product_cost": 500.0, "item_number": "b"},
        {"order_number": "m", "item_number": "a"},
        {"order_number": "fine"},
    ]
    df = clean_lines(lines(spark, *rows))
    assert dr.negative_margin_lines(df).count() == 2
    order = dr.with_text_lists(dr.loss_orders(df), dr.ORDER_MEMBERS).first()
    assert (order.order_number, order.item_number, order.line_quantity) == ("m", "a, b", 4.0)
    assert dr.loss_order_count(df).first()[0] == 1


@pytest.mark.parametrize("operator", [dr.loss_orders, dr.item_drilldown, dr.agreement_drilldown])
def test_drilldowns_have_one_plan_without_lists(spark, ol, operator):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("drilldown-build", "building")
    table = operator(ol)
    assert not tracker.getJobIdsForGroup("drilldown-build")
    spark.sparkContext._jsc.clearJobGroup()
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "array" not in {t[:5] for _, t in table.dtypes}
    totals, members = table.filter("member_column IS NULL"), table.filter("member_column IS NOT NULL")
    keys = table.columns[: table.columns.index("member_column")]
    assert totals.count() == totals.select(keys).distinct().count() == members.select(keys).distinct().count()
    assert members.count() == members.distinct().count() and members.filter("line_product_revenue IS NOT NULL").count() == 0


def test_missing_values_leave_other_figures_alone(spark):
    rows = [
        {"customer_name": None, "line_product_cost": 500.0},
        {"line_freight_cost": None, "order_region": None},
        {"item_number": None, "line_quantity": 0.0},
        {"order_number": None, "line_product_cost": 500.0},
        {"category_1": None, "customer_agreement": None},
    ]
    df = enriched_lines(lines(spark, *rows))
    assert df.count() == 5
    order = by(dr.with_text_lists(dr.loss_orders(df), dr.ORDER_MEMBERS), "order_number")["o1"]
    assert (order.line_product_revenue, order.line_freight_cost, order.item_number) == (400.0, 30.0, "i1")
    drill = {(r.category_column, r.item_number): r for r in dr.with_text_lists(dr.item_drilldown(df), dr.ITEM_MEMBERS).collect()}
    assert set(drill) == {(f"category_{k}", "i1") for k in (1, 2, 3)}
    assert (drill["category_2", "i1"].line_product_revenue, drill["category_1", "i1"].line_product_revenue) == (400.0, 300.0)
    assert (drill["category_1", "i1"].order_region, drill["category_1", "i1"].customer_name) == ("north", "c1")
    assert dr.loss_order_count(df).first()[0] == 1
    assert da.negative_margins(df, "item_number").count() == 1


def test_loss_orders_cover_all_negative_lines(ol):
    bad = ol.filter("delivered_margin < 0").select("order_number").distinct()
    kept = dr.loss_orders(ol).filter("member_column IS NULL").select("order_number")
    assert bad.exceptAll(kept).count() == 0 and kept.exceptAll(bad).count() == 0


def test_lossy_group_can_have_negative_loss(spark):
    rows = [
        {"line_product_revenue": 1.0, "line_product_cost": 60.0},
        {"line_product_revenue": 10000.0, "line_product_cost": 10.0},
    ]
    got = da.negative_margins(clean_lines(lines(spark, *rows)), "item_number", "product_margin").first()
    assert got.avg_product_margin < 0 and got.total_loss < 0


def test_swings_are_never_negative(ol):
    assert da.margin_swings(ol, "item_number").filter("margin_swing < 0").count() == 0


def test_monthly_margin_of_chosen_values(ol):
    wide = da.monthly_margin_wide(ol, "order_channel", "product_margin", ["1-URGENT", "nowhere"])
    assert wide.columns == ["month_end", "1-URGENT", "nowhere"]
    assert wide.filter(F.col("nowhere").isNotNull()).count() == 0
    assert da.monthly_margin(ol, "order_channel", "product_margin", ["nowhere"]).count() == 0


def test_drilldown_lists_and_selected_categories(spark):
    rows = [
        {"order_region": "south", "customer_agreement": "b"},
        {"order_region": "north", "customer_agreement": "a"},
        {"category_1": "other", "order_region": "east"},
    ]
    df = clean_lines(lines(spark, *rows))
    picked = dr.item_drilldown(df, {"category_1": ["x"], "category_2": ["nothing"]}).collect()
    found = [(r.member_column, r.member) for r in picked]
    assert sorted(x for x in found if x[0]) == [
        ("customer_agreement", "a"), ("customer_agreement", "b"), ("customer_name", "c1"), ("order_region", "north"), ("order_region", "south")
    ]
    assert found.count((None, None)) == 1
    everything = dr.item_drilldown(df)
    assert everything.filter("member_column IS NULL").count() == 4
    lowest = dr.lowest_members(everything.filter("category_value = 'x'"), "order_region").collect()
    assert [r.order_region for r in lowest] == ["north", "south"]
    long = dr.item_drilldown_members(df, {"category_1": ["x"]})
    assert long.filter("member_column = 'order_region'").count() == 2


def test_drilldown_files(spark, tmp_path):
    df = clean_lines(lines(spark, {}, {"order_region": "south", "category_1": "w w"}))
    path = str(tmp_path / "items")
    ds.write_drilldown(dr.item_drilldown(df), path)
    back = ds.read_drilldown(spark, path, "category_1", "w w")
    assert [(r.item_number, r.order_region) for r in back.collect()] == [("i1", "south")]
    assert len(back.inputFiles()) == 1 and "w w" in back.inputFiles()[0].replace("%20", " ")
    assert back.columns[-2:] == ["category_column", "category_value"] and back.first().category_value == "w w"
    assert ds.read_drilldown(spark, path, "category_1", "none").count() == 0
    assert ds.read_drilldown(spark, str(tmp_path / "missing")).count() == 0
    odd = "a=b/c:d%e'f"
    strange = clean_lines(lines(spark, {"category_1": odd}, {"category_1": "{x}*?"}))
    ds.write_drilldown(dr.item_drilldown(strange), str(tmp_path / "odd"))
    for value in (odd, "{x}*?"):
        assert [r.category_value for r in ds.read_drilldown(spark, str(tmp_path / "odd"), "category_1", value).collect()] == [value]
    assert ds.read_drilldown(spark, str(tmp_path / "odd"), "category_1").count() == 2
    listed = ds.drilldown_catalog(ds.read_drilldown(spark, path)).collect()
    assert [tuple(r) for r in listed] == [
        ("category_1", "w w"), ("category_1", "x"), ("category_2", "y"), ("category_3", "z")
    ]
    ds.write_drilldown(dr.agreement_drilldown(df), str(tmp_path / "agreements"))
    again = ds.read_drilldown(spark, str(tmp_path / "agreements"), schema=ds.AGREEMENT_SCHEMA)
    assert again.count() == 4
    ds.write_overall_margin(dr.category_overall_margin(df), str(tmp_path / "overall"))
    text = spark.read.text(str(tmp_path / "overall")).filter("category_value = 'x'").first().value
    assert text == "Overall delivered margin: 41.67%"


def test_stock_and_margin_flags_do_not_overlap(ol):
    assert inv.overstocked(ol).join(inv.understocked(ol), "item_number").count() == 0
    assert inv.low_margin_high_volume(ol).join(inv.high_margin_low_volume(ol), "item_number").count() == 0


def test_f_score_equals_correlation_of_an_indicator(ol):
    level = ol.first().order_channel
    r = ol.select(F.corr((F.col("order_channel") == level).cast("double"), "delivered_margin")).first()[0]
    want = r * r / (1 - r * r) * (ol.count() - 2)
    assert by(da.feature_f_scores(ol, "order_channel"), "feature")[level].importance == pytest.approx(want)


def test_anova_matches_the_definition_and_table_values(spark, ol):
    pdf = ol.select("order_channel", "delivered_margin").toPandas()
    groups = [g.delivered_margin for _, g in pdf.groupby("order_channel")]
    mean = pdf.delivered_margin.mean()
    between = sum(len(g) * (g.mean() - mean) ** 2 for g in groups) / (len(groups) - 1)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(pdf) - len(groups))
    got = st.anova_test(ol, "order_channel").first()
    assert got.f_value == pytest.approx(between / within)
    assert got.significant == (got.p_value < 0.05)
    # Published 5 % and 1 % points of the F distribution.
    from tallyline.functions.fdist import f_upper_tail

    assert f_upper_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_upper_tail(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-5)
    assert f_upper_tail(5.6363, 5, 10) == pytest.approx(0.01, abs=1e-5)
    assert f_upper_tail(0.0, 3, 7) == 1.0


def test_planted_line_is_found(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), F.col("id").cast("double").alias("x"))
    fit = st.linear_fit(df.withColumn("y", 3 * F.col("x") + 2), "x", "y", "k").first()
    assert (fit.slope, fit.intercept, fit.r2) == pytest.approx((3.0, 2.0, 1.0))
    assert fit.train_rows + fit.test_rows == 500


def test_histogram_has_empty_bins_and_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "x double")
    got = [tuple(r) for r in pf.histogram(df, "x", 5).orderBy("bin").collect()]
    assert got == [(1, 0.0, 2.0, 2), (2, 2.0, 4.0, 0), (3, 4.0, 6.0, 0), (4, 6.0, 8.0, 0), (5, 8.0, 10.0, 1)]
    assert pf.histogram(df.filter("x IS NULL"), "x", 5).count() == 0
    assert [r.rows for r in pf.histogram(df.filter("x = 0.5"), "x", 3).orderBy("bin").collect()] == [1, 0, 0]


@pytest.mark.parametrize("demand,mode", [("power", "unit"), ("exp", "multiplier")])
def test_scenario_summary_adds_up_the_rows(ol, demand, mode):
    rows = pr.scenario_rows(ol, 7, demand, mode).toPandas().groupby("step")
    got = pr.scenario_summary(ol, 7, demand, mode).toPandas().set_index("step").sort_index()
    assert list(got.avg_margin_rate) == pytest.approx(list(rows.margin_rate.mean()))
    assert list(got.total_quantity) == pytest.approx(list(rows.new_quantity.sum()))
    assert list(got.avg_profit) == pytest.approx(list(rows.profit.mean()))
    assert "sequence(" not in pr.scenario_summary(ol, 7)._jdf.queryExecution().optimizedPlan().toString()


def test_histogram_counts_every_line(ol):
    got = pf.histogram(ol, "line_volume_cbm").agg(F.sum("rows"), F.max("bin"), F.min("bin")).first()
    assert tuple(got) == (ol.count(), 50, 1)


@pytest.mark.parametrize("operator", [po.product_performance, ch.channel_performance, cu.customer_features, fr.order_summary])
def test_results_do_not_depend_on_partitioning(ol, operator):
    money = lambda df: df.select(*(c for c, t in df.dtypes if not c.startswith("avg_")))
    once, again = money(operator(ol)), money(operator(ol.repartition(13)))
    assert once.exceptAll(again).count() == 0


@pytest.mark.parametrize("name", ["item_drilldown_members", "price_elasticity", "margin_swings", "loss_order_count"])
def test_lines_are_scanned_once(spark, name):
    # Other tables than the cached ones of the ``ol`` fixture, whose plan would be shown twice.
    plan = all_queries()[name](spark, SF.replace("sf0.001", "sf0.01"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet [l_") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_consolidation_on_one_day(spark):
    rows = [
        {"order_number": "p", "line_volume_cbm": 1.0, "line_freight_cost": 10.0},
        {"order_number": "q", "line_volume_cbm": 4.0, "line_freight_cost": 20.0},
        {"order_number": "r", "line_volume_cbm": 4.0, "line_freight_cost": 20.0, "order_date": dt.date(2024, 1, 2)},
    ]
    got = fr.consolidation_savings(clean_lines(lines(spark, *rows))).first()
    assert got.avg_cost_unconsolidated == pytest.approx((10 + 5 + 5) / 3)
    assert got.avg_cost_consolidated == pytest.approx((6 + 5) / 2)


def test_scenarios_keep_returned_and_huge_lines(ol):
    returned, huge = (r[0] for r in ol.select(LINE_KEY).orderBy(LINE_KEY).limit(2).collect())
    quantity = F.when(F.col(LINE_KEY) == returned, -3.0).when(F.col(LINE_KEY) == huge, 1e16).otherwise(F.col("line_quantity"))
    changed = ol.withColumn("line_quantity", quantity)
    best = pr.price_scenarios(changed, steps=5)
    assert best.count() == ol.count()
    found = by(best.where(F.col(LINE_KEY).isin(returned, huge)), LINE_KEY)
    assert found[returned]["new_quantity"] == 1.0 and found[huge]["new_quantity"] >= 1.0
    every = pr.scenario_rows(changed, steps=5)
    assert every.count() == 5 * ol.count() and every.where("new_quantity < 1").count() == 0
