"""Customer-agreement tables and renegotiation ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_mean, means, month_start, ratio, sums
from tallyline.operators.channels import LINE_MARGINS, line_count, mean_margin
from tallyline.operators.grouping import attach, quantile_row, with_positions, with_row
from tallyline.operators.profile import grouped
from tallyline.sources.scratch import written


def agreement_analysis(ol: DataFrame) -> DataFrame:
    return (
        grouped(ol, "customer_agreement")
        .agg(
            F.count_distinct("customer_name").alias("customer_count"),
            line_count(),
            *sums("total_revenue"),
            *means(**LINE_MARGINS),
        )
        .withColumn("avg_order_value", ratio("total_revenue", "order_count"))
        .withColumn("revenue_per_customer", ratio("total_revenue", "customer_count"))
    )


def agreement_pricing(ol: DataFrame) -> DataFrame:
    """Average price per agreement as a ratio of sums."""
    return (
        grouped(ol, "customer_agreement")
        .agg(*sums("line_product_revenue", "line_quantity"))
        .withColumn("avg_price", ratio("line_product_revenue", "line_quantity"))
    )


def _revenue_and_margin(ol: DataFrame) -> DataFrame:
    return grouped(ol, "customer_agreement").agg(
        *sums("total_revenue"), *(exact_mean(c).alias(name) for name, c in LINE_MARGINS.items())
    )


def agreement_profitability(ol: DataFrame) -> DataFrame:
    """Profit estimated as revenue times mean margin."""
    return _revenue_and_margin(ol).select(
        "customer_agreement",
        "total_revenue",
        "avg_delivered_margin",
        (F.col("total_revenue") * F.col("avg_delivered_margin") / 100.0).alias("profit"),
    )


def monthly_agreement(ol: DataFrame) -> DataFrame:
    return grouped(ol.withColumn("month", month_start("order_date")), "month", "customer_agreement").agg(
        *sums("total_revenue"), mean_margin()
    )


def monthly_agreement_latest(ol: DataFrame, n: int = 30) -> DataFrame:
    return monthly_agreement(ol).orderBy(F.desc("month"), "customer_agreement").limit(n)


def monthly_agreement_top(ol: DataFrame, n: int = 5) -> DataFrame:
    """Monthly rows of the agreements with most revenue."""
    best = (
        grouped(ol, "customer_agreement")
        .agg(*sums("total_revenue"))
        .orderBy(F.desc("total_revenue"), "customer_agreement")
        .limit(n)
        .select("customer_agreement")
    )
    # ``n`` keys: always small enough to broadcast.
    return monthly_agreement(ol.join(F.broadcast(best), "customer_agreement", "left_semi"))


def low_freight_margin_agreements(ol: DataFrame) -> DataFrame:
    """Agreements whose mean freight margin is below the median agreement."""
    table = written(
        _revenue_and_margin(ol).select("customer_agreement", "avg_freight_margin", "total_revenue"), "agreements"
    )
    median = quantile_row(table, ["avg_freight_margin"], [0.5])
    return (
        with_row(table, median, "_median")
        .filter(F.col("avg_freight_margin") < F.col("_median.of")["avg_freight_margin"][0])
        .drop("_median")
    )


def pricing_variation(ol: DataFrame, n: int = 10) -> DataFrame:
    """Agreements whose line prices vary most."""
    return (
        grouped(ol, "customer_agreement")
        .agg(F.avg("avg_price").alias("mean_price"), F.stddev_samp("avg_price").alias("price_std"))
        .withColumn("coefficient_of_variation", ratio("price_std", "mean_price"))
        .filter(F.col("coefficient_of_variation").isNotNull())
        .orderBy(F.desc("coefficient_of_variation"), "customer_agreement")
        .limit(n)
    )


def average_rank(df: DataFrame, value: str, rank: str, split_rows: int | None = None) -> DataFrame:
    """Descending rank of ``value``; ties share the mean of their positions.

    Positions come from the distinct values, found part by part, so no task
    sorts the whole column.
    """
    hist = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_positions(hist, [], value, "_n", split_rows)
    from_top = F.col("_size") - (F.col("_first") + F.col("_last")) / 2.0
    return attach(df, placed.select(value, from_top.alias(rank)), [value])


def renegotiation_candidates(ol: DataFrame, n: int = 10, split_rows: int | None = None) -> DataFrame:
    """High-revenue, low-margin agreements: smallest revenue rank minus margin rank."""
    table = written(
        _revenue_and_margin(ol).select("customer_agreement", "total_revenue", "avg_delivered_margin"), "agreements"
    )
    ranked = average_rank(
        average_rank(table, "total_revenue", "revenue_rank", split_rows),
        "avg_delivered_margin",
        "margin_rank",
        split_rows,
    )
    return (
        ranked.withColumn("renegotiation_score", F.col("revenue_rank") - F.col("margin_rank"))
        .orderBy("renegotiation_score", "customer_agreement")
        .limit(n)
        .select(
            "customer_agreement",
            "total_revenue",
            "avg_delivered_margin",
            "revenue_rank",
            "margin_rank",
            "renegotiation_score",
        )
    )
