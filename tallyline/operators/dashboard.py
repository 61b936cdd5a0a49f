"""Tables behind the margin dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_sum, ratio
from tallyline.operators.grouping import with_row
from tallyline.operators.profile import grouped, long_form
from tallyline.schema import DIMENSIONS

# Revenue and cost columns behind each margin column.
MARGIN_INPUTS = {
    "product_margin": ("line_product_revenue", "line_product_cost"),
    "freight_margin": ("line_freight_revenue", "line_freight_cost"),
    "delivered_margin": ("total_revenue", "total_cost"),
}


def monthly_margin(
    ol: DataFrame, dim: str, margin: str = "delivered_margin", values: Sequence[str] | None = None
) -> DataFrame:
    """Mean line margin per value of ``dim`` and month (labelled by its last day)."""
    lines = ol if values is None else ol.filter(F.col(dim).isin(list(values)))
    return grouped(lines.withColumn("month_end", F.last_day("order_date")), dim, "month_end").agg(
        F.avg(margin).alias(f"avg_{margin}")
    )


def monthly_margin_wide(ol: DataFrame, dim: str, margin: str, values: Sequence[str]) -> DataFrame:
    """The chosen values as columns; listing them saves Spark a distinct pass."""
    return monthly_margin(ol, dim, margin, values).groupBy("month_end").pivot(dim, list(values)).agg(
        F.first(f"avg_{margin}")
    )


def overall_monthly_margin(ol: DataFrame, dim: str, margin: str = "delivered_margin") -> DataFrame:
    """Mean of the monthly cells of each value."""
    return monthly_margin(ol, dim, margin).groupBy(dim).agg(F.avg(f"avg_{margin}").alias("overall_average"))


def margin_swings(ol: DataFrame, dim: str, margin: str = "delivered_margin") -> DataFrame:
    """Largest minus smallest monthly ratio-of-sums margin per value of ``dim``."""
    revenue, cost = MARGIN_INPUTS[margin]
    monthly = (
        grouped(ol.withColumn("month_end", F.last_day("order_date")), dim, "month_end")
        .agg(exact_sum(revenue).alias("_revenue"), exact_sum(cost).alias("_cost"))
        .withColumn("_margin", ratio(F.col("_revenue") - F.col("_cost"), "_revenue") * 100.0)
    )
    return monthly.groupBy(dim).agg((F.max("_margin") - F.min("_margin")).alias("margin_swing"))


def negative_margins(ol: DataFrame, dim: str, margin: str = "delivered_margin") -> DataFrame:
    """Loss (cost minus revenue) of values with a negative mean margin, else 0."""
    revenue, cost = MARGIN_INPUTS[margin]
    table = grouped(ol, dim).agg(
        F.avg(margin).alias(f"avg_{margin}"), exact_sum(revenue).alias(revenue), exact_sum(cost).alias(cost)
    )
    loss = F.when(F.col(f"avg_{margin}") < 0, F.col(cost) - F.col(revenue)).otherwise(0.0)
    return table.withColumn("total_loss", loss)


def dimension_values(ol: DataFrame, dims: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Distinct values of every dimension, in one pass."""
    return long_form(ol, dims, "dimension", "value").distinct()


def feature_f_scores(ol: DataFrame, dim: str) -> DataFrame:
    """Univariate F of each level indicator of ``dim`` against delivered margin.

    With one indicator the correlation follows from the level's count and sum
    and the global moments, so no one-hot columns are built.
    """
    y = F.col("delivered_margin")
    whole = ol.agg(F.count(y).cast("double").alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"))
    levels = grouped(ol, dim).agg(F.count(y).cast("double").alias("_k"), F.avg(y).alias("_mean"))
    n, k = F.col("_all.n"), F.col("_k")
    # r^2 of an indicator: k (mean_k - mean)^2 / ((n - k) var)
    r2 = ratio(k * F.pow(F.col("_mean") - F.col("_all.mean"), F.lit(2.0)), (n - k) * F.col("_all.var"))
    return (
        with_row(levels, whole, "_all")
        .withColumn("_r2", r2)
        .select(F.col(dim).alias("feature"), ratio(F.col("_r2") * (n - 2.0), 1.0 - F.col("_r2")).alias("importance"))
    )


def numeric_f_score(ol: DataFrame, column: str) -> DataFrame:
    """Univariate F of a numeric column against delivered margin."""
    r = F.corr(column, "delivered_margin")
    row = ol.agg(r.alias("_r"), F.count(F.lit(1)).cast("double").alias("_n"))
    r2 = F.col("_r") * F.col("_r")
    return row.select(
        F.lit(column).alias("feature"), ratio(r2 * (F.col("_n") - 2.0), 1.0 - r2).alias("importance")
    )
