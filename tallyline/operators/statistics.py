"""Correlation, variance analysis and simple regression as aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.columns import in_train_split, ratio
from tallyline.functions.fdist import f_upper_tail
from tallyline.operators.grouping import with_row
from tallyline.operators.profile import KEY_METRICS, grouped
from tallyline.schema import LINE_KEY

CORRELATED = (*KEY_METRICS[:6], "total_revenue", *KEY_METRICS[6:])


def correlation_matrix(ol: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair of columns.

    Means first, then the sums of centred products: plain sums keep the
    aggregation small enough to be compiled, which one ``corr`` per pair is not.
    """
    means = ol.agg(*(F.avg(c).alias(c) for c in columns))
    centred = with_row(ol.select(*columns), means, "_mean").select(
        *((F.col(c) - F.col(f"_mean.{c}")).alias(c) for c in columns)
    )
    pairs = list(combinations_with_replacement(columns, 2))
    row = centred.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs))

    def cell(a: str, b: str) -> Column:
        product = F.col(f"`{a}*{b}`") if (a, b) in pairs else F.col(f"`{b}*{a}`")
        r = ratio(product, F.sqrt(F.col(f"`{a}*{a}`") * F.col(f"`{b}*{b}`")))
        return F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), r.alias("r"))

    return row.select(F.inline(F.array(*(cell(a, b) for a in columns for b in columns))))


def anova_f(ol: DataFrame, group: str, value: str = "delivered_margin") -> DataFrame:
    """One-way ANOVA: F with its degrees of freedom, as one row."""
    groups = (
        grouped(ol.filter(F.col(value).isNotNull()), group)
        .agg(
            F.count(F.lit(1)).cast("double").alias("_n"),
            F.avg(value).alias("_mean"),
            F.var_pop(value).alias("_var"),
        )
    )
    overall = groups.agg(F.try_divide(F.sum(F.col("_n") * F.col("_mean")), F.sum("_n")).alias("mean"))
    row = with_row(groups, overall, "_grand").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("_n").cast("bigint").alias("rows"),
        F.sum(F.col("_n") * F.pow(F.col("_mean") - F.col("_grand.mean"), F.lit(2.0))).alias("_between"),
        F.sum(F.col("_n") * F.col("_var")).alias("_within"),
    )
    between = ratio("_between", (F.col("groups") - 1).cast("double"))
    within = ratio("_within", (F.col("rows") - F.col("groups")).cast("double"))
    return row.select(F.lit(group).alias("grouping"), "groups", "rows", ratio(between, within).alias("f_value"))


def anova_test(ol: DataFrame, group: str, value: str = "delivered_margin", alpha: float = 0.05) -> DataFrame:
    """``anova_f`` with its p-value and verdict.

    The tail probability is worked out on the single result row.
    """

    @F.pandas_udf("double")
    def tail(f: pd.Series, groups: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([f_upper_tail(a, k - 1.0, n - k) for a, k, n in zip(f, groups, rows)])

    return (
        anova_f(ol, group, value)
        .withColumn("p_value", tail("f_value", "groups", "rows"))
        .withColumn("significant", F.col("p_value") < alpha)
    )


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean squared error, mean absolute error and R squared, as one row."""
    error = F.col(label) - F.col(prediction)
    return df.agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(label).alias("_var"),
    ).select("mse", "mae", (1.0 - ratio("mse", "_var")).alias("r2"))


def linear_fit(df: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """Least squares of ``y`` on ``x`` over the train split, scored on the holdout."""
    flagged = df.select(F.col(x).alias("_x"), F.col(y).alias("_y"), in_train_split(key).alias("_train"))
    line = (
        flagged.filter("_train")
        .agg(
            F.regr_slope("_y", "_x").alias("slope"),
            F.regr_intercept("_y", "_x").alias("intercept"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    scored = with_row(flagged.filter(~F.col("_train")), line, "_line")
    predicted = scored.withColumn("_p", F.col("_line.intercept") + F.col("_line.slope") * F.col("_x"))
    error = F.col("_y") - F.col("_p")
    return predicted.agg(
        F.first("_line.slope").alias("slope"),
        F.first("_line.intercept").alias("intercept"),
        F.first("_line.rows").alias("train_rows"),
        F.count(F.lit(1)).alias("test_rows"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop("_y").alias("_var"),
    ).select(
        "slope",
        "intercept",
        "train_rows",
        "test_rows",
        "mse",
        "mae",
        (1.0 - ratio("mse", "_var")).alias("r2"),
    )


def volume_cost_fit(ol: DataFrame) -> DataFrame:
    """Freight cost explained by line volume."""
    return linear_fit(ol, "line_volume_cbm", "line_freight_cost", LINE_KEY)
