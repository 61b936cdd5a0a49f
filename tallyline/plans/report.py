"""The batch report: every table of each section, and a writer for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators import agreements as ag
from tallyline.operators import channels as ch
from tallyline.operators import customers as cu
from tallyline.operators import drilldown as dr
from tallyline.operators import elasticity as el
from tallyline.operators import freight as fr
from tallyline.operators import inventory as inv
from tallyline.operators import models as mo
from tallyline.operators import products as po
from tallyline.operators import profile as pf
from tallyline.operators import series as se
from tallyline.operators import statistics as st

Operator = Callable[[DataFrame], DataFrame]

SECTIONS: dict[str, dict[str, Operator]] = {
    "description": {
        "key_metric_summary": pf.key_metric_summary,
        "order_line_counts": pf.order_line_counts,
        "channel_region_counts": pf.channel_region_counts,
    },
    "time_series": {
        "daily_totals": pf.daily_totals,
        "seasonal_decompose": se.seasonal_decompose,
        "forecast_daily": se.forecast_daily,
    },
    "customers": {
        "customer_clusters": mo.customer_clusters,
        "cluster_profile": lambda ol: mo.cluster_profile(mo.customer_clusters(ol), cu.CUSTOMER_FEATURES, "clv"),
        "cluster_outliers": lambda ol: mo.cluster_outliers(
            mo.customer_clusters(ol), "customer_name", cu.CUSTOMER_FEATURES
        ),
        "feature_importance": mo.cluster_feature_importance,
    },
    "products": {
        "product_performance": po.product_performance,
        "top_products": po.top_products,
        "bottom_products": po.bottom_products,
        "product_contributions": po.product_contributions,
        "margin_sum_by_category": po.margin_sum_by_category,
        "elasticity_extremes": el.elasticity_extremes,
        "top_revenue_elasticity": el.top_revenue_elasticity,
        "freight_elasticity_bottom": el.freight_elasticity_bottom,
        "price_variance": po.price_variance,
        "monthly_top_products": po.monthly_top_products,
        "seasonal_performance": po.seasonal_performance,
        "season_products": po.season_products,
    },
    "channels_and_agreements": {
        "channel_performance": ch.channel_performance,
        "customer_group_channel": cu.customer_group_channel,
        "region_channel_top": ch.region_channel_top,
        "category_channel": ch.category_channel,
        "monthly_channel_latest": ch.monthly_channel_latest,
        "channel_efficiency": ch.channel_efficiency,
        "improvement_areas": ch.improvement_areas,
        "anova_channel": lambda ol: st.anova_test(ol, "order_channel"),
        "agreement_analysis": ag.agreement_analysis,
        "agreement_pricing": ag.agreement_pricing,
        "agreement_profitability": ag.agreement_profitability,
        "monthly_agreement_latest": ag.monthly_agreement_latest,
        "renegotiation_candidates": ag.renegotiation_candidates,
        "anova_agreement": lambda ol: st.anova_test(ol, "customer_agreement"),
        "low_freight_margin_agreements": ag.low_freight_margin_agreements,
        "pricing_variation": ag.pricing_variation,
    },
    "freight": {
        "order_summary": lambda ol: pf.describe(
            fr.order_summary(ol),
            ["line_volume_cbm", "line_freight_cost", "line_freight_revenue", "freight_cost_per_cbm"],
        ),
        "region_freight_top": fr.region_freight_top,
        "region_clusters": mo.region_clusters,
        "consolidation_savings": fr.consolidation_savings,
        "consolidation_top_regions": fr.consolidation_top_regions,
    },
    "prediction": {
        "correlation_matrix": st.correlation_matrix,
        "volume_cost_fit": st.volume_cost_fit,
        "margin_linear_model": lambda ol: mo.margin_linear_model(ol)[1],
        "revenue_forest": lambda ol: mo.revenue_forest(ol)[1],
        "next_month_model": se.next_month_model,
    },
    "inventory": {
        "slow_moving": inv.slow_moving_report,
        "profitability_extremes": lambda ol: inv.profitability_extremes(ol, "item_number"),
        "profitability_by_category": lambda ol: inv.profitability_by(ol, "category_1"),
        "profitability_by_region": lambda ol: inv.profitability_by(ol, "order_region"),
        "profitability_clusters": mo.profitability_clusters,
        "stock_flags": inv.stock_flags,
        "margin_volume_flags": inv.margin_volume_flags,
    },
    "losses": {
        "loss_orders": lambda ol: dr.with_text_lists(dr.loss_orders(ol), dr.ORDER_MEMBERS),
        "mean_margin_by_agreement": lambda ol: dr.mean_margin_by(ol, "customer_agreement"),
        "bottom_categories": dr.bottom_categories,
    },
}


def batch_report(ol: DataFrame, sections: Iterable[str] = tuple(SECTIONS)) -> dict[str, DataFrame]:
    """Tables of the asked sections, by ``section/name``."""
    return {f"{s}/{name}": operator(ol) for s in sections for name, operator in SECTIONS[s].items()}


def write_report(ol: DataFrame, path: str, sections: Iterable[str] = tuple(SECTIONS)) -> None:
    """Write each table as CSV under ``path/section/name``.

    The order lines are kept on the executors between tables, on disk where
    memory is short.
    """
    ol.persist()
    try:
        for name, table in batch_report(ol, sections).items():
            flat = table.select(
                *(
                    F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, T.ArrayType) else f.name
                    for f in table.schema
                )
            )
            flat.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    finally:
        ol.unpersist()
