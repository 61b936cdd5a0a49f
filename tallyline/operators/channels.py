"""Sales-channel tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import (
    exact_sum,
    freight_profit,
    means,
    month_start,
    product_profit,
    ratio,
    revenue,
    sums,
)
from tallyline.operators.grouping import with_row
from tallyline.operators.products import MONEY
from tallyline.operators.profile import grouped

LINE_MARGINS = {
    "avg_product_margin": "product_margin",
    "avg_freight_margin": "freight_margin",
    "avg_delivered_margin": "delivered_margin",
}


def line_count() -> Column:
    return F.count("order_number").alias("order_count")


def mean_value() -> Column:
    return F.avg("total_revenue").alias("avg_order_value")


def mean_margin() -> Column:
    return F.avg("delivered_margin").alias("avg_delivered_margin")


def channel_performance(ol: DataFrame) -> DataFrame:
    """Lines, sums, mean margins and distinct customers per channel."""
    table = grouped(ol, "order_channel").agg(
        line_count(),
        *sums(*MONEY),
        *means(**LINE_MARGINS),
        F.count_distinct("customer_name").alias("customer_count"),
    )
    return (
        table.withColumn("total_revenue", revenue())
        .withColumn("total_profit", product_profit() + freight_profit())
        .withColumn("avg_order_value", ratio("total_revenue", "order_count"))
    )


def region_channel(ol: DataFrame) -> DataFrame:
    return grouped(ol, "order_region", "order_channel").agg(line_count(), mean_value(), mean_margin())


def region_channel_top(ol: DataFrame, n: int = 5) -> DataFrame:
    """The (region, channel) pairs with most lines."""
    return region_channel(ol).orderBy(F.desc("order_count"), "order_region", "order_channel").limit(n)


def region_channel_top_regions(ol: DataFrame, n: int = 5) -> DataFrame:
    """All channels of the regions with most lines."""
    best = (
        grouped(ol, "order_region")
        .agg(line_count())
        .orderBy(F.desc("order_count"), "order_region")
        .limit(n)
        .select("order_region")
    )
    # ``n`` keys: always small enough to broadcast.
    return region_channel(ol).join(F.broadcast(best), "order_region", "left_semi")


def category_channel(ol: DataFrame) -> DataFrame:
    return grouped(ol, "category_1", "order_channel").agg(line_count(), mean_value(), *means(**LINE_MARGINS))


def monthly_channel(ol: DataFrame) -> DataFrame:
    return grouped(ol.withColumn("month", month_start("order_date")), "month", "order_channel").agg(
        line_count(), mean_value(), mean_margin()
    )


def monthly_channel_latest(ol: DataFrame, n: int = 12) -> DataFrame:
    return monthly_channel(ol).orderBy(F.desc("month"), "order_channel").limit(n)


def channel_efficiency(ol: DataFrame) -> DataFrame:
    """Means per channel; ``orders_per_volume`` is lines over *mean* volume."""
    return (
        grouped(ol, "order_channel")
        .agg(
            line_count(),
            *means(avg_quantity="line_quantity", avg_volume_cbm="line_volume_cbm"),
            mean_margin(),
        )
        .withColumn("orders_per_volume", ratio("order_count", "avg_volume_cbm"))
    )


def improvement_areas(ol: DataFrame) -> DataFrame:
    """Channels below the mean over channels in margin or order value."""
    table = (
        grouped(ol, "order_channel")
        .agg(line_count(), exact_sum("total_revenue").alias("total_revenue"), mean_margin())
        .withColumn("avg_order_value", ratio("total_revenue", "order_count"))
    )
    mean = table.agg(F.avg("avg_delivered_margin").alias("margin"), F.avg("avg_order_value").alias("value"))
    compared = with_row(table, mean, "_mean")
    margin = compared.filter(F.col("avg_delivered_margin") < F.col("_mean.margin")).select(
        "order_channel",
        F.lit("delivered_margin").alias("area"),
        F.col("avg_delivered_margin").alias("channel_value"),
        F.format_string("Below average delivered margin (%.2f%%)", "avg_delivered_margin").alias("finding"),
    )
    value = compared.filter(F.col("avg_order_value") < F.col("_mean.value")).select(
        "order_channel",
        F.lit("order_value").alias("area"),
        F.col("avg_order_value").alias("channel_value"),
        F.format_string("Below average order value ($%.2f)", "avg_order_value").alias("finding"),
    )
    return margin.unionByName(value)
