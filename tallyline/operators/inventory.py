"""Sales-rate, stock and profitability flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_sum, month_start, ratio, sums
from tallyline.operators.grouping import quantile_row, with_row
from tallyline.operators.profile import grouped
from tallyline.sources.scratch import written


def item_sales_stats(ol: DataFrame) -> DataFrame:
    """Mean, deviation and sum of monthly sales per item; months without sales are absent."""
    monthly = grouped(ol.withColumn("month", month_start("order_date")), "month", "item_number").agg(
        *sums("line_quantity", "total_profit")
    )
    return (
        monthly.groupBy("item_number")
        .agg(
            F.avg("line_quantity").alias("avg_monthly_sales"),
            F.stddev_samp("line_quantity").alias("std_monthly_sales"),
            exact_sum("line_quantity").alias("total_sales"),
            exact_sum("total_profit").alias("total_profit"),
        )
        .withColumn("cv_sales", ratio("std_monthly_sales", "avg_monthly_sales"))
    )


def slow_moving(ol: DataFrame) -> DataFrame:
    """Items selling less per month than the first quartile of items."""
    stats = written(item_sales_stats(ol), "item-sales")
    quartile = quantile_row(stats, ["avg_monthly_sales"], [0.25])
    return (
        with_row(stats, quartile, "_cut")
        .filter(F.col("avg_monthly_sales") < F.col("_cut.of")["avg_monthly_sales"][0])
        .drop("_cut")
    )


def slow_moving_report(ol: DataFrame, n: int = 5) -> DataFrame:
    return slow_moving(ol).orderBy("avg_monthly_sales", "item_number").limit(n)


def _flags(table: DataFrame, rate: str, size: str, low_large: str, high_small: str) -> DataFrame:
    """Flag rows with a below-median rate and a top-quarter size, and the reverse."""
    table = written(table, "flags")
    cut = with_row(table, quantile_row(table, [rate, size], [0.25, 0.5, 0.75]), "_cut")
    median = F.col("_cut.of")[rate][1]
    small, large = F.col("_cut.of")[size][0], F.col("_cut.of")[size][2]
    flag = F.when((F.col(rate) < median) & (F.col(size) > large), low_large).when(
        (F.col(rate) > median) & (F.col(size) < small), high_small
    )
    return cut.withColumn("flag", flag).filter(F.col("flag").isNotNull()).drop("_cut")


def stock_flags(ol: DataFrame) -> DataFrame:
    """Overstocked and understocked items in one table."""
    return _flags(item_sales_stats(ol), "avg_monthly_sales", "total_sales", "overstocked", "understocked")


def overstocked(ol: DataFrame) -> DataFrame:
    """Below-median monthly sales but total sales above the third quartile."""
    return stock_flags(ol).filter(F.col("flag") == "overstocked").drop("flag")


def understocked(ol: DataFrame) -> DataFrame:
    """Above-median monthly sales but total sales below the first quartile."""
    return stock_flags(ol).filter(F.col("flag") == "understocked").drop("flag")


def profitability_by(ol: DataFrame, dim: str) -> DataFrame:
    """Sums and profit margin (profit over product revenue) per value of ``dim``.

    Items and categories carry the quantity sold, other dimensions the number of lines.
    """
    if dim in ("item_number", "category_1"):
        volume = exact_sum("line_quantity").alias("line_quantity")
    else:
        volume = F.count("order_number").alias("order_count")
    return (
        grouped(ol, dim)
        .agg(volume, *sums("line_product_revenue", "line_product_cost", "total_profit"))
        .withColumn("profit_margin", ratio("total_profit", "line_product_revenue") * 100.0)
    )


def profitability_extremes(ol: DataFrame, dim: str, n: int = 10) -> DataFrame:
    """Values of ``dim`` with most and least profit."""
    table = profitability_by(ol, dim)
    best = table.orderBy(F.desc("total_profit"), dim).limit(n).withColumn("end", F.lit("top"))
    worst = table.orderBy(F.asc("total_profit"), dim).limit(n).withColumn("end", F.lit("bottom"))
    return best.unionByName(worst)


def margin_volume_flags(ol: DataFrame) -> DataFrame:
    """Items to reprice (low margin, high volume) and to promote (the reverse)."""
    return _flags(
        profitability_by(ol, "item_number"),
        "profit_margin",
        "line_quantity",
        "low_margin_high_volume",
        "high_margin_low_volume",
    )


def low_margin_high_volume(ol: DataFrame) -> DataFrame:
    return margin_volume_flags(ol).filter(F.col("flag") == "low_margin_high_volume").drop("flag")


def high_margin_low_volume(ol: DataFrame) -> DataFrame:
    return margin_volume_flags(ol).filter(F.col("flag") == "high_margin_low_volume").drop("flag")
