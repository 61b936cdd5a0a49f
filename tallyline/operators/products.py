"""Product, price and season tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import (
    cost,
    exact_sum,
    freight_profit,
    margin_pct,
    month_start,
    product_profit,
    ratio,
    ratio_or_zero,
    revenue,
    season,
    sums,
)
from tallyline.operators.grouping import top_per_group, with_row
from tallyline.operators.profile import grouped, long_form
from tallyline.schema import CATEGORY_COLUMNS

MONEY = ("line_product_revenue", "line_product_cost", "line_freight_revenue", "line_freight_cost")


def product_performance(ol: DataFrame) -> DataFrame:
    """Sums, profits and ratio-of-sums margins per item."""
    totals = grouped(ol, "item_number").agg(
        *sums("line_quantity", *MONEY, "line_volume_cbm"),
        F.count_distinct("order_number").alias("order_count"),
    )
    return totals.withColumns(
        {
            "product_profit": product_profit(),
            "freight_profit": freight_profit(),
            "total_profit": product_profit() + freight_profit(),
            "product_margin": margin_pct("line_product_revenue", "line_product_cost"),
            "freight_margin": margin_pct("line_freight_revenue", "line_freight_cost"),
            "delivered_margin": margin_pct(revenue(), cost()),
            "avg_price": ratio_or_zero("line_product_revenue", "line_quantity"),
        }
    )


def top_products(ol: DataFrame, n: int = 10, metric: str = "total_profit") -> DataFrame:
    return product_performance(ol).orderBy(F.desc(metric), "item_number").limit(n)


def bottom_products(ol: DataFrame, n: int = 10, metric: str = "total_profit") -> DataFrame:
    return product_performance(ol).orderBy(F.asc(metric), "item_number").limit(n)


def product_contributions(ol: DataFrame) -> DataFrame:
    """Share of each item in total profit and revenue, in percent.

    The grand totals are one row, read as a scalar subquery.
    """
    items = grouped(ol, "item_number").agg(*sums("total_profit", "total_revenue"))
    total = ol.agg(exact_sum("total_profit").alias("profit"), exact_sum("total_revenue").alias("revenue"))
    return with_row(items, total, "_total").select(
        "item_number",
        "total_profit",
        "total_revenue",
        (ratio("total_profit", "_total.profit") * 100.0).alias("profit_contribution"),
        (ratio("total_revenue", "_total.revenue") * 100.0).alias("revenue_contribution"),
    )


def margin_sum_by_category(ol: DataFrame) -> DataFrame:
    """Sum of line margins per value of each category column."""
    return (
        long_form(ol, CATEGORY_COLUMNS, "category_column", "category_value", keep=["delivered_margin"])
        .groupBy("category_column", "category_value")
        .agg(F.sum("delivered_margin").alias("delivered_margin_sum"))
    )


def price_variance(ol: DataFrame, n: int = 10) -> DataFrame:
    """Items whose unit price varies most for their volume."""
    price = ratio("line_product_revenue", "line_quantity")
    items = grouped(ol, "item_number").agg(
        *sums("line_quantity", "line_product_revenue", "total_profit"),
        F.var_samp(price).alias("_var"),
        F.avg(price).alias("_mean"),
        F.count(F.lit(1)).alias("_rows"),
    )
    spread = F.when((F.col("_rows") > 1) & (F.col("_mean") != 0), ratio("_var", "_mean")).otherwise(0.0)
    return (
        items.withColumn("price_variance", spread)
        .withColumn("volume_price_score", F.col("price_variance") * F.col("line_quantity"))
        .filter(F.col("volume_price_score").isNotNull())
        .select(
            "item_number",
            ratio_or_zero("line_product_revenue", "line_quantity").alias("avg_price"),
            "price_variance",
            "line_quantity",
            "volume_price_score",
            "total_profit",
        )
        .orderBy(F.desc("volume_price_score"), "item_number")
        .limit(n)
    )


def _profit_table(ol: DataFrame, *keys: str) -> DataFrame:
    return (
        grouped(ol, *keys)
        .agg(*sums("line_quantity", *MONEY))
        .withColumn("total_profit", product_profit() + freight_profit())
        .withColumn("delivered_margin", ratio("total_profit", revenue()) * 100.0)
    )


def monthly_product(ol: DataFrame) -> DataFrame:
    return _profit_table(ol.withColumn("month", month_start("order_date")), "month", "item_number")


def monthly_top_products(ol: DataFrame, n: int = 5) -> DataFrame:
    """Monthly rows of the items with most profit."""
    best = (
        grouped(ol, "item_number")
        .agg(*sums("total_profit"))
        .orderBy(F.desc("total_profit"), "item_number")
        .limit(n)
        .select("item_number")
    )
    # ``n`` rows: always small enough to broadcast.
    return monthly_product(ol.join(F.broadcast(best), "item_number", "left_semi"))


def seasonal_performance(ol: DataFrame) -> DataFrame:
    seasons = _profit_table(ol.withColumn("season", season("order_date")), "season")
    return seasons.withColumn("total_revenue", revenue()).withColumn("total_cost", cost())


def season_products(ol: DataFrame, n: int = 3) -> DataFrame:
    """Most profitable items of each season."""
    items = _profit_table(ol.withColumn("season", season("order_date")), "season", "item_number")
    return top_per_group(items, ["season"], [F.desc("total_profit"), F.asc("item_number")], n)
