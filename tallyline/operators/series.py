"""Daily and monthly series: decomposition, lags and forecasts.

Series are formed after aggregation to days or months, so one series never
has more rows than the calendar has days; ordered windows run per series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import exact_sum, month_start
from tallyline.operators.profile import grouped
from tallyline.operators.statistics import linear_fit

DECOMPOSED = ("line_volume_cbm", "total_revenue", "product_margin", "freight_margin", "delivered_margin")
FORECAST = ("total_revenue", "product_margin", "freight_margin", "delivered_margin")


def daily_series(ol: DataFrame, metrics: Sequence[str], dims: Sequence[str] = ()) -> DataFrame:
    """Daily values in long form: ``series_key``, ``order_date``, ``value``.

    Margins are averaged over lines, everything else is summed. ``dims`` gives
    one series per metric and dimension value.
    """
    daily = grouped(ol, *dims, "order_date").agg(
        *(F.avg(m).alias(m) if m.endswith("_margin") else exact_sum(m).alias(m) for m in metrics)
    )
    return daily.unpivot([*dims, "order_date"], list(metrics), "series_key", "value")


def seasonal_decompose(ol: DataFrame, period: int = 7, dims: Sequence[str] = ()) -> DataFrame:
    """Additive decomposition with an odd period: centred mean trend, seasonal, residual.

    Positions follow the order of existing days; the half-period at either end
    has no trend.
    """
    keys = [*dims, "series_key"]
    half = period // 2
    along = Window.partitionBy(*keys).orderBy("order_date")
    around = along.rowsBetween(-half, half)
    trended = daily_series(ol, DECOMPOSED, dims).select(
        *keys,
        "order_date",
        "value",
        ((F.row_number().over(along) - 1) % period).alias("position"),
        F.when(F.count("value").over(around) == period, F.avg("value").over(around)).alias("trend"),
    )
    at = trended.groupBy(*keys, "position").agg(F.avg(F.col("value") - F.col("trend")).alias("_at"))
    whole = Window.partitionBy(*keys)
    seasonal = at.select(*keys, "position", (F.col("_at") - F.avg("_at").over(whole)).alias("seasonal"))
    return trended.join(seasonal, [*keys, "position"]).withColumn(
        "residual", F.col("value") - F.col("trend") - F.col("seasonal")
    )


def monthly_revenue(ol: DataFrame) -> DataFrame:
    return grouped(ol.withColumn("month", month_start("order_date")), "month").agg(
        exact_sum("total_revenue").alias("total_revenue")
    )


def revenue_lag(ol: DataFrame) -> DataFrame:
    """Revenue of each month with that of the month before; the first month is dropped."""
    along = Window.orderBy("month")  # one row per month of the whole table
    return (
        monthly_revenue(ol)
        .withColumn("prev_month_revenue", F.lag("total_revenue").over(along))
        .filter(F.col("prev_month_revenue").isNotNull())
    )


def next_month_model(ol: DataFrame) -> DataFrame:
    """Revenue regressed on the previous month's revenue, with holdout scores."""
    lagged = revenue_lag(ol).withColumn("_key", F.col("month").cast("string"))
    return linear_fit(lagged, "prev_month_revenue", "total_revenue", "_key")


def _weekly_forecast(dates: pd.Series, values: np.ndarray, steps: int) -> pd.DataFrame:
    """Autoregression of weekly differences on lags 1, 7 and 8, rolled forward."""
    lags, y = (1, 7, 8), list(values)
    z = np.asarray(values[7:]) - np.asarray(values[:-7]) if len(values) > 7 else np.zeros(0)
    coefficients, sigma = np.zeros(1 + len(lags)), float(np.std(z)) if len(z) else 0.0
    if len(z) - max(lags) > 2 * len(coefficients):
        rows = np.arange(max(lags), len(z))
        x = np.column_stack([np.ones(len(rows)), *(z[rows - lag] for lag in lags)])
        coefficients = np.linalg.lstsq(x, z[rows], rcond=None)[0]
        sigma = float(np.sqrt(np.mean((z[rows] - x @ coefficients) ** 2)))
    z = list(z)
    for _ in range(steps):
        past = [z[-lag] if len(z) >= lag else 0.0 for lag in lags]
        z.append(float(coefficients[0] + np.dot(coefficients[1:], past)))
        y.append((y[-7] if len(y) >= 7 else y[-1]) + z[-1])
    # Weights of past shocks give the growth of the forecast variance.
    shock, level = [1.0], [1.0]
    for j in range(1, steps):
        shock.append(sum(c * shock[j - lag] for c, lag in zip(coefficients[1:], lags) if j >= lag))
        level.append(shock[j] + (level[j - 7] if j >= 7 else 0.0))
    spread = 1.96 * sigma * np.sqrt(np.cumsum(np.square(level)))
    ahead = np.asarray(y[-steps:])
    return pd.DataFrame(
        {
            "step": np.arange(1, steps + 1, dtype="int32"),
            "order_date": [dates.iloc[-1] + pd.Timedelta(days=i + 1) for i in range(steps)],
            "forecast": ahead,
            "lower": ahead - spread,
            "upper": ahead + spread,
        }
    )


def forecast_daily(ol: DataFrame, steps: int = 30, dims: Sequence[str] = ()) -> DataFrame:
    """Daily forecast with a 95 % band for each metric (and dimension value).

    Serves the purpose of a seasonal ARIMA of period 7, not its numbers. Each
    Python call gets one daily series.
    """
    keys = [*dims, "series_key"]
    series = daily_series(ol, FORECAST, dims).filter(F.col("value").isNotNull())

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order_date")
        out = _weekly_forecast(pd.to_datetime(pdf["order_date"]), pdf["value"].to_numpy(), steps)
        out["order_date"] = out["order_date"].dt.date
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "step", "order_date", "forecast", "lower", "upper"]]

    fields = ", ".join(f"{k} string" for k in keys)
    return series.groupBy(*keys).applyInPandas(
        fit, f"{fields}, step int, order_date date, forecast double, lower double, upper double"
    )
