"""Named queries: every operator over the star view of the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import agreements as ag
from tallyline.operators import channels as ch
from tallyline.operators import customers as cu
from tallyline.operators import dashboard as da
from tallyline.operators import drilldown as dr
from tallyline.operators import elasticity as el
from tallyline.operators import freight as fr
from tallyline.operators import inventory as inv
from tallyline.operators import lines as li
from tallyline.operators import models as mo
from tallyline.operators import pricing as pr
from tallyline.operators import products as po
from tallyline.operators import profile as pf
from tallyline.operators import series as se
from tallyline.operators import statistics as st
from tallyline.schema import LINE_KEY, MEASURES
from tallyline.sources import drilldown as ds
from tallyline.sources.order_lines import star_view
from tallyline.sources.scratch import in_slices, scratch_dir, shuffles_cleared, sliced, written

Query = Callable[[SparkSession, str], DataFrame]


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.clean_lines(star_view(spark, sf_dir))


# Added before rounding: exact halves such as 0.0000125 then round up everywhere.
NUDGE = 1e-9


def rounded(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles to fixed decimals, so sums in another order compare equal; -0.0 becomes 0.0.

    Values worked out within one row need no rounding: ``digits=None``.
    """

    def shown(name: str):
        c = F.col(name)
        if digits is not None:
            c = F.round(c + F.lit(NUDGE), digits)
        return (c + F.lit(0.0)).alias(name)

    return df.select(*(shown(f.name) if isinstance(f.dataType, T.DoubleType) else f.name for f in df.schema))


def on_lines(operator: Callable[[DataFrame], DataFrame], digits: int | None = 6) -> Query:
    return lambda spark, sf_dir: rounded(operator(order_lines(spark, sf_dir)), digits)


def on_all_lines(operator: Callable[[DataFrame], DataFrame], digits: int | None = 6) -> Query:
    """For tables whose lines may have missing values: nothing is dropped beforehand."""
    return lambda spark, sf_dir: rounded(operator(li.enriched_lines(star_view(spark, sf_dir))), digits)


def with_gaps(ol: DataFrame) -> DataFrame:
    """Order lines with some values missing, by rules that SQL can repeat."""
    item, order = F.col("item_number").cast("bigint"), F.col("order_number").cast("bigint")
    rules = {
        "customer_name": item % 7 == 1, "customer_agreement": (item + order) % 11 == 2, "order_region": order % 13 == 3,
        "category_2": item % 17 == 4, "item_number": (item + 2 * order) % 19 == 5, "order_channel": order % 23 == 6,
        "line_freight_cost": (item + 3 * order) % 9 == 7, "line_product_revenue": (item + 5 * order) % 29 == 8,
    }
    return ol.withColumns({c: F.when(~rule, F.col(c)) for c, rule in rules.items()})


def on_gaps(operator: Callable[[DataFrame], DataFrame], digits: int | None = 6) -> Query:
    return lambda spark, sf_dir: rounded(operator(li.enriched_lines(with_gaps(star_view(spark, sf_dir)))), digits)


def _item_drilldown(ol: DataFrame) -> DataFrame:
    return in_slices(ol, "item_number", dr.item_drilldown, "item-drilldown")


def _read_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole item drill-down, then read one category column back."""
    path = scratch_dir(spark, "item-drilldown")
    with shuffles_cleared(spark):
        for i, part in enumerate(sliced(li.enriched_lines(star_view(spark, sf_dir)), "item_number")):
            ds.write_drilldown(dr.item_drilldown(part), path, "append" if i else "overwrite", "gzip")
    return rounded(ds.read_drilldown(spark, path, "category_1"))


SCENARIO_COLUMNS = (
    LINE_KEY, "customer_name", "order_date", "order_channel", "order_region", *(m for m in MEASURES if m != "line_volume_cbm"),
)


def _best_prices(lines: DataFrame) -> DataFrame:
    """The best scenario of every line. The market is worked out once where the lines are many and read in slices."""
    market = written(pr.market(lines), "market") if len(sliced(lines, LINE_KEY)) > 1 else None
    return pr.price_scenarios(lines, known=market)


def _scored(ol: DataFrame) -> DataFrame:
    """Scenario scores of the best price; the line's own figures stand in for model outputs."""
    # A large input is joined once, in slices of its orders, and written.
    ol = in_slices(ol, "order_number", lambda part: part.select(*SCENARIO_COLUMNS), "scenario-lines")
    ol = li.with_totals(li.with_margins(ol))
    with shuffles_cleared(ol.sparkSession):
        best = _best_prices(ol).select(LINE_KEY, "new_price", "new_quantity")
        segments = cu.value_tertiles(ol).withColumnRenamed("customer_group", "customer_segment")
    lines = ol.select(
        LINE_KEY,
        "customer_name",
        F.month("order_date").alias("month"),
        F.col("total_profit").alias("predicted_profit"),
        F.col("delivered_margin").alias("predicted_margin"),
    )
    scored = lines.join(best, LINE_KEY).withColumnRenamed("new_quantity", "predicted_quantity")
    return pr.scenario_score(ol, scored, segments)


def _segment_multipliers(ol: DataFrame) -> DataFrame:
    segments = cu.value_tertiles(ol).withColumnRenamed("customer_group", "customer_segment")
    return pr.segment_multipliers(ol, segments)


SQL_CHECKED: dict[str, Query] = {
    # sources and per-line projections
    "order_lines": lambda spark, sf_dir: rounded(star_view(spark, sf_dir), None),
    "line_margins": on_lines(li.line_margins, None),
    "line_totals": on_lines(li.line_totals, None),
    "line_margins_fraction": on_lines(li.line_margins_fraction, None),
    "line_calendar": on_lines(li.line_calendar),
    "line_ratios": on_lines(li.line_ratios, None),
    "line_freight_price": on_lines(li.line_freight_price, None),
    "model_inputs": on_lines(lambda ol: li.model_inputs(ol, keep=(LINE_KEY,)), None),
    # profile
    "key_metric_summary": on_lines(pf.key_metric_summary),
    "daily_summary": on_lines(pf.daily_summary, 4),
    "order_line_counts": on_lines(pf.order_line_counts),
    "channel_region_counts": on_lines(pf.channel_region_counts),
    "daily_totals": on_lines(pf.daily_totals),
    "histogram": on_lines(lambda ol: pf.histogram(ol, "line_volume_cbm")),
    "histogram_clv": on_lines(lambda ol: pf.histogram(cu.customer_features(ol), "clv", 20)),
    "histogram_freight_cost": on_lines(lambda ol: pf.histogram(fr.order_summary(ol), "freight_cost_per_cbm", 30)),
    # customers
    "customer_features": on_lines(cu.customer_features),
    "customer_total_value": on_lines(cu.customer_total_value),
    "value_tertiles": on_lines(cu.value_tertiles),
    "customer_group_channel": on_lines(cu.customer_group_channel),
    "rolling_7": on_lines(cu.rolling_7),
    # products
    "product_performance": on_lines(po.product_performance),
    "top_products": on_lines(po.top_products),
    "bottom_products": on_lines(po.bottom_products),
    "product_contributions": on_lines(po.product_contributions),
    "margin_sum_by_category": on_lines(po.margin_sum_by_category, 4),
    "price_variance": on_lines(po.price_variance),
    "monthly_product": on_lines(po.monthly_product),
    "monthly_top_products": on_lines(po.monthly_top_products),
    "seasonal_performance": on_lines(po.seasonal_performance),
    "season_products": on_lines(po.season_products),
    # elasticity
    "price_elasticity": on_lines(el.price_elasticity),
    "freight_elasticity": on_lines(el.freight_elasticity),
    "elasticity_with_margin": on_lines(el.elasticity_with_margin),
    "elasticity_extremes": on_lines(el.elasticity_extremes),
    "freight_elasticity_bottom": on_lines(el.freight_elasticity_bottom),
    "top_revenue_elasticity": on_lines(el.top_revenue_elasticity),
    # channels
    "channel_performance": on_lines(ch.channel_performance),
    "region_channel": on_lines(ch.region_channel),
    "region_channel_top": on_lines(ch.region_channel_top),
    "region_channel_top_regions": on_lines(ch.region_channel_top_regions),
    "category_channel": on_lines(ch.category_channel),
    "monthly_channel": on_lines(ch.monthly_channel),
    "monthly_channel_latest": on_lines(ch.monthly_channel_latest),
    "channel_efficiency": on_lines(ch.channel_efficiency),
    "improvement_areas": on_lines(ch.improvement_areas),
    # agreements
    "agreement_analysis": on_lines(ag.agreement_analysis),
    "agreement_pricing": on_lines(ag.agreement_pricing),
    "agreement_profitability": on_lines(ag.agreement_profitability, 4),
    "monthly_agreement": on_lines(ag.monthly_agreement),
    "monthly_agreement_latest": on_lines(ag.monthly_agreement_latest),
    "monthly_agreement_top": on_lines(ag.monthly_agreement_top),
    "low_freight_margin_agreements": on_lines(ag.low_freight_margin_agreements),
    "pricing_variation": on_lines(ag.pricing_variation),
    "renegotiation_candidates": on_lines(ag.renegotiation_candidates),
    # freight
    "order_summary": on_lines(fr.order_summary),
    "region_freight": on_lines(fr.region_freight),
    "region_freight_top": on_lines(fr.region_freight_top),
    "consolidated_orders": on_lines(fr.consolidated_orders),
    "consolidation_savings": on_lines(fr.consolidation_savings),
    "consolidation_by_region": on_lines(fr.consolidation_by_region),
    "consolidation_top_regions": on_lines(fr.consolidation_top_regions),
    # inventory and profitability
    "item_sales_stats": on_lines(inv.item_sales_stats),
    "slow_moving": on_lines(inv.slow_moving),
    "slow_moving_report": on_lines(inv.slow_moving_report),
    "overstocked": on_lines(inv.overstocked),
    "understocked": on_lines(inv.understocked),
    "profitability_by_item": on_lines(lambda ol: inv.profitability_by(ol, "item_number")),
    "profitability_by_category": on_lines(lambda ol: inv.profitability_by(ol, "category_1")),
    "profitability_by_customer": on_lines(lambda ol: inv.profitability_by(ol, "customer_name")),
    "profitability_by_region": on_lines(lambda ol: inv.profitability_by(ol, "order_region")),
    "profitability_extremes": on_lines(lambda ol: inv.profitability_extremes(ol, "item_number")),
    "margin_volume_flags": on_lines(inv.margin_volume_flags),
    # dashboard
    "monthly_margin": on_all_lines(lambda ol: da.monthly_margin(ol, "category_1")),
    "monthly_margin_selected": on_all_lines(
        lambda ol: da.monthly_margin_wide(ol, "order_channel", "freight_margin", ["1-URGENT", "2-HIGH"]).select(
            "month_end", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high")
        )
    ),
    "overall_monthly_margin": on_all_lines(lambda ol: da.overall_monthly_margin(ol, "category_2", "product_margin")),
    "margin_swings": on_all_lines(lambda ol: da.margin_swings(ol, "category_1")),
    "margin_swings_product": on_all_lines(lambda ol: da.margin_swings(ol, "category_2", "product_margin")),
    "margin_swings_freight": on_all_lines(lambda ol: da.margin_swings(ol, "item_number", "freight_margin")),
    "negative_margins": on_all_lines(lambda ol: da.negative_margins(ol, "item_number")),
    "negative_margins_product": on_all_lines(lambda ol: da.negative_margins(ol, "category_3", "product_margin")),
    "negative_margins_freight": on_all_lines(lambda ol: da.negative_margins(ol, "order_region", "freight_margin")),
    "dimension_values": on_all_lines(da.dimension_values),
    "feature_f_scores": on_all_lines(lambda ol: da.feature_f_scores(ol, "customer_agreement")),
    "numeric_f_score": on_all_lines(lambda ol: da.numeric_f_score(ol, "line_volume_cbm")),
    # drill-down
    "negative_margin_lines": on_all_lines(lambda ol: dr.negative_margin_lines(ol).select(LINE_KEY, "order_number")),
    "loss_orders": on_all_lines(dr.loss_orders),
    "loss_order_count": on_all_lines(dr.loss_order_count),
    "mean_margin_by_agreement": on_all_lines(lambda ol: dr.mean_margin_by(ol, "customer_agreement")),
    "bottom_categories": on_all_lines(dr.bottom_categories),
    "item_drilldown": on_all_lines(_item_drilldown),
    "item_drilldown_members": on_all_lines(dr.item_drilldown_members),
    "agreement_drilldown": on_all_lines(dr.agreement_drilldown),
    "category_overall_margin": on_all_lines(dr.category_overall_margin),
    "drilldown_catalog": on_all_lines(lambda ol: ds.drilldown_catalog(dr.category_values(ol))),
    "read_drilldown": _read_drilldown,
    "lowest_items": on_all_lines(lambda ol: dr.lowest_items(dr.item_drilldown(ol))),
    "lowest_agreements": on_all_lines(lambda ol: dr.lowest_members(dr.item_drilldown(ol), "customer_agreement")),
    "lowest_regions": on_all_lines(lambda ol: dr.lowest_members(dr.item_drilldown(ol), "order_region")),
    # the same tables where values are missing
    "monthly_margin_gaps": on_gaps(lambda ol: da.monthly_margin(ol, "category_2")),
    "margin_swings_gaps": on_gaps(lambda ol: da.margin_swings(ol, "category_2", "product_margin")),
    "negative_margins_gaps": on_gaps(lambda ol: da.negative_margins(ol, "item_number")),
    "negative_margin_lines_gaps": on_gaps(lambda ol: dr.negative_margin_lines(ol).select(LINE_KEY, "order_number")),
    "loss_orders_gaps": on_gaps(dr.loss_orders),
    "mean_margin_by_agreement_gaps": on_gaps(lambda ol: dr.mean_margin_by(ol, "customer_agreement")),
    "bottom_categories_gaps": on_gaps(dr.bottom_categories),
    "item_drilldown_gaps": on_gaps(_item_drilldown),
    "agreement_drilldown_gaps": on_gaps(dr.agreement_drilldown),
    # statistics
    "correlation_matrix": on_lines(st.correlation_matrix),
    "anova_channel": on_lines(lambda ol: st.anova_f(ol, "order_channel")),
    "anova_agreement": on_lines(lambda ol: st.anova_f(ol, "customer_agreement")),
    "linear_fit": on_lines(st.volume_cost_fit, 4),
    "regression_metrics": on_lines(
        lambda ol: st.regression_metrics(
            ol.withColumn("prediction", 50.0 + 2500.0 * F.col("line_volume_cbm")), "line_freight_cost", "prediction"
        )
    ),
    "order_describe": on_lines(
        lambda ol: pf.describe(fr.order_summary(ol), ["line_volume_cbm", "line_freight_cost", "line_freight_revenue", "freight_cost_per_cbm"])
    ),
    # series
    "seasonal_decompose": on_lines(se.seasonal_decompose),
    "monthly_revenue": on_lines(se.monthly_revenue),
    "revenue_lag": on_lines(se.revenue_lag),
    "next_month_model": on_lines(se.next_month_model, 2),
    # pricing
    "demand_cells": on_lines(pr.demand_cells),
    "log_log_elasticity": on_lines(pr.log_log_elasticity),
    "price_grid": on_lines(pr.price_grid),
    "price_range": on_lines(pr.price_range),
    "recommend_freight_price": on_lines(pr.recommend_freight_price),
    "target_gap": on_lines(pr.target_gap),
    "price_scenarios": on_lines(pr.price_scenarios),
    "scenario_summary": on_lines(pr.scenario_summary, 4),
    "dataset_stats": on_lines(pr.dataset_stats),
    "segment_multipliers": on_lines(_segment_multipliers),
    "month_multipliers": on_lines(pr.month_multipliers),
    "scenario_score": on_lines(_scored),
}


def _predicted(ol: DataFrame) -> DataFrame:
    """What customer segments need of the order lines, with the margin model's prediction."""
    model = mo.line_models(ol, ["delivered_margin"])

    def predicted(part: DataFrame) -> DataFrame:
        shown = model.predict(part, {"delivered_margin": "predicted_margin"})
        return shown.select("customer_name", "total_revenue", "line_quantity", "delivered_margin", "predicted_margin")

    return in_slices(ol, "item_number", predicted, "predicted-lines")


def _freight_price_from_model(ol: DataFrame) -> DataFrame:
    """Recommended prices from predicted instead of actual freight cost."""
    scored = mo.line_models(ol, ["line_freight_cost"]).predict(ol, {"line_freight_cost": "predicted_cost"})
    return pr.recommend_freight_price(scored, "predicted_cost")


def _line_predictions(ol: DataFrame) -> DataFrame:
    """What the four line models say of every line."""
    names = {n: f"predicted_{n}" for n in mo.LINE_MODELS}
    model = mo.line_models(ol)
    return in_slices(ol, "item_number", lambda part: model.predict(part, names).select(LINE_KEY, *names.values()), "line-predictions")


def _scenario_score_models(ol: DataFrame) -> DataFrame:
    """Scenario scores from fitted profit, quantity and margin models and k-means segments."""
    names = {"total_profit": "predicted_profit", "line_quantity": "predicted_quantity", "delivered_margin": "predicted_margin"}
    model = mo.line_models(ol, list(names))

    def predicted(part: DataFrame) -> DataFrame:
        return model.predict(part, names).select(*SCENARIO_COLUMNS, *names.values())

    lines = in_slices(ol, "item_number", predicted, "predicted-lines", keep=True)
    lines = li.with_totals(li.with_margins(lines)).withColumn("month", F.month("order_date"))
    with shuffles_cleared(ol.sparkSession):
        best = _best_prices(lines).select(LINE_KEY, "new_price")
        segments = mo.customer_segments(lines, "predicted_margin")
    scored = lines.select(LINE_KEY, "customer_name", "month", *names.values()).join(best, LINE_KEY)
    return pr.scenario_score(lines, scored, segments)


def _target_encoded(ol: DataFrame) -> DataFrame:
    return mo.target_encode(ol).select(LINE_KEY, *(f"{c}_encoded" for c in mo.ENCODED))


def _coded(ol: DataFrame) -> DataFrame:
    columns = mo.LINE_CATEGORIES
    return mo.category_codes(ol, columns).select(LINE_KEY, *(f"{c}_code" for c in columns))


SQL_CHECKED |= {
    "train_test_split": on_lines(mo.split_flags),
    "category_codes": on_lines(_coded),
    "target_encode": on_lines(_target_encoded),
    "segment_features": on_lines(lambda ol: cu.segment_features(ol, "product_margin")),
    "customer_clusters": on_lines(mo.customer_clusters),
    "customer_cluster_profile": on_lines(
        lambda ol: mo.cluster_profile(mo.customer_clusters(ol), cu.CUSTOMER_FEATURES, "clv")
    ),
    "best_and_worst_cluster": on_lines(
        lambda ol: mo.best_and_worst_cluster(
            mo.cluster_profile(mo.customer_clusters(ol), cu.CUSTOMER_FEATURES), "avg_clv"
        )
    ),
    "cluster_feature_importance": on_lines(mo.cluster_feature_importance),
    "cluster_outliers": on_lines(
        lambda ol: mo.cluster_outliers(mo.customer_clusters(ol), "customer_name", cu.CUSTOMER_FEATURES)
    ),
    "region_clusters": on_lines(mo.region_clusters),
    "region_cluster_profile": on_lines(lambda ol: mo.cluster_profile(mo.region_clusters(ol), mo.REGION_FEATURES)),
    "profitability_clusters": on_lines(mo.profitability_clusters),
    "profitability_cluster_profile": on_lines(
        lambda ol: mo.cluster_profile(mo.profitability_clusters(ol), mo.PROFIT_FEATURES)
    ),
    "customer_cluster_describe": on_lines(
        lambda ol: mo.cluster_describe(mo.customer_clusters(ol), cu.CUSTOMER_FEATURES), 4
    ),
    "profitability_factors": on_lines(mo.profitability_factors),
    "margin_regressor_cv": on_lines(lambda ol: mo.margin_regressor_cv(ol)[2]),
    "margin_regressor_importance": on_lines(lambda ol: mo.margin_regressor_cv(ol)[1]),
    "profit_and_quantity_models": on_lines(lambda ol: mo.line_model_scores(ol, ["total_profit", "line_quantity"]), 4),
    "freight_and_margin_models": on_lines(lambda ol: mo.line_model_scores(ol, ["line_freight_cost", "delivered_margin"]), 4),
    "line_predictions": on_lines(_line_predictions, 4),
    "customer_segments_observed": on_lines(lambda ol: mo.customer_segments(ol, "product_margin")),
    "line_segments": on_lines(
        lambda ol: mo.with_segments(ol, mo.customer_segments(ol, "product_margin")).select(
            LINE_KEY, "customer_name", "customer_segment", "avg_predicted_margin"
        )
    ),
}

# Depend on library, seed or iteration: checked by their properties in tests.
PROPERTY_CHECKED: dict[str, Query] = {
    "anova_test": on_lines(lambda ol: st.anova_test(ol, "order_channel")),
    "customer_segments": on_lines(lambda ol: mo.customer_segments(_predicted(ol), "predicted_margin")),
    "margin_linear_model": on_lines(lambda ol: mo.margin_linear_model(ol)[1]),
    "margin_linear_scores": on_lines(lambda ol: mo.margin_linear_model(ol)[2]),
    "revenue_forest": on_lines(lambda ol: mo.revenue_forest(ol)[1]),
    "margin_boosted_trees": on_lines(lambda ol: mo.margin_boosted_trees(ol)[1]),
    "freight_price_from_model": on_lines(_freight_price_from_model),
    "scenario_score_models": on_lines(_scenario_score_models),
    "forecast_daily": on_lines(se.forecast_daily),
}


def all_queries() -> dict[str, Query]:
    return {**SQL_CHECKED, **PROPERTY_CHECKED}
