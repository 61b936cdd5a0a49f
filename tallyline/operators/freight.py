"""Freight cost by order, region and consolidation day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import sums
from tallyline.operators.profile import grouped
from tallyline.schema import LINE_KEY


def cost_per_cbm() -> Column:
    return F.when(
        F.col("line_volume_cbm") > 0, F.col("line_freight_cost") / F.col("line_volume_cbm")
    ).otherwise(0.0)


def order_summary(ol: DataFrame) -> DataFrame:
    """Volume and freight per order; the region is that of the smallest line key."""
    return (
        grouped(ol, "order_number")
        .agg(
            *sums("line_volume_cbm", "line_freight_cost", "line_freight_revenue"),
            F.min_by("order_region", LINE_KEY).alias("order_region"),
        )
        .withColumn("freight_cost_per_cbm", cost_per_cbm())
    )


def region_freight(ol: DataFrame) -> DataFrame:
    """Mean order volume, freight cost and cost per cbm by region."""
    return (
        grouped(order_summary(ol), "order_region")
        .agg(*(F.avg(c).alias(f"avg_{c}") for c in ("line_volume_cbm", "line_freight_cost", "freight_cost_per_cbm")))
        .dropna("any")
    )


def region_freight_top(ol: DataFrame, n: int = 5) -> DataFrame:
    return region_freight(ol).orderBy(F.desc("avg_freight_cost_per_cbm"), "order_region").limit(n)


def consolidated_orders(ol: DataFrame) -> DataFrame:
    """Lines of one region and day taken as one shipment."""
    return (
        grouped(ol.withColumn("order_day", F.to_date("order_date")), "order_day", "order_region")
        .agg(F.count("order_number").alias("order_count"), *sums("line_volume_cbm", "line_freight_cost"))
        .withColumn("freight_cost_per_cbm", cost_per_cbm())
    )


def consolidation_savings(ol: DataFrame) -> DataFrame:
    """Mean cost per cbm with and without consolidation, and the saving in percent."""
    mean = F.avg("freight_cost_per_cbm")
    apart = order_summary(ol).agg(mean.alias("avg_cost_unconsolidated"))
    together = consolidated_orders(ol).agg(mean.alias("_mean")).scalar()
    return apart.withColumn("avg_cost_consolidated", together).withColumn(
        "savings_percentage",
        (1.0 - F.try_divide("avg_cost_consolidated", "avg_cost_unconsolidated")) * 100.0,
    )


def consolidation_by_region(ol: DataFrame) -> DataFrame:
    """Consolidated against original cost per cbm for every region."""
    together = consolidated_orders(ol).groupBy("order_region").agg(
        F.avg("freight_cost_per_cbm").alias("freight_cost_per_cbm_consolidated"),
        F.avg("order_count").alias("avg_daily_lines"),
    )
    apart = region_freight(ol).select(
        "order_region", F.col("avg_freight_cost_per_cbm").alias("freight_cost_per_cbm_original")
    )
    saving = F.when(
        F.col("freight_cost_per_cbm_original") > 0,
        (1.0 - F.col("freight_cost_per_cbm_consolidated") / F.col("freight_cost_per_cbm_original")) * 100.0,
    ).otherwise(0.0)
    return together.join(apart, "order_region").withColumn("savings_percentage", saving)


def consolidation_top_regions(ol: DataFrame, n: int = 5) -> DataFrame:
    return consolidation_by_region(ol).orderBy(F.desc("savings_percentage"), "order_region").limit(n)
