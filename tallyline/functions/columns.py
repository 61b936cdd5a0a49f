"""Column expressions shared by every operator; all stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL, so aggregates treat them as missing."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def margin_pct(revenue: str | Column, cost: str | Column) -> Column:
    """Margin in percent; 0 when revenue is 0, NULL when an input is NULL."""
    revenue, cost = col(revenue), col(cost)
    return F.when(revenue == 0, F.lit(0.0)).otherwise((revenue - cost) / revenue * 100.0)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """Division that yields NULL, not an ANSI error, for a zero denominator."""
    return F.try_divide(col(numerator), col(denominator))


def ratio_or_zero(numerator: str | Column, denominator: str | Column) -> Column:
    """Division that yields 0 for a zero denominator and keeps NULL as NULL."""
    numerator, denominator = col(numerator), col(denominator)
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def clipped(c: str | Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (greatest/least would drop it)."""
    c = col(c)
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def _counted_sum(c: Column, over: WindowSpec | None = None) -> Column:
    """Sum by long counters of units, millionths and trillionths: the same in every order; NULL when all NULL."""
    units = F.floor(c)
    rest = (c - units) * 1e6
    millionths = F.floor(rest)
    trillionths = F.rint((rest - millionths) * 1e6).cast("bigint")
    sums = [F.sum(units), F.sum(millionths), F.sum(trillionths)]
    if over is not None:
        sums = [s.over(over) for s in sums]
    units, millionths, trillionths = (s.cast("double") for s in sums)
    return units + (millionths + trillionths / F.lit(1e6)) / F.lit(1e6)


def exact_sum(c: str | Column, over: WindowSpec | None = None) -> Column:
    """Sum that does not depend on row order or partitioning; 0 when all NULL.

    Values are taken to twelve decimals and added in three long counters: order-free and several times faster
    than a decimal sum. With ANSI mode on, an overflow (totals beyond 9e18) is an error.
    """
    return F.coalesce(_counted_sum(col(c).cast("double"), over), F.lit(0.0))


def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def season(c: str | Column) -> Column:
    """Northern-European season of a date."""
    m = F.month(col(c))
    return (
        F.when(m.isin(12, 1, 2), "Winter")
        .when(m.isin(3, 4, 5), "Spring")
        .when(m.isin(6, 7, 8), "Summer")
        .when(m.isin(9, 10, 11), "Autumn")
    )


def in_train_split(key: str | Column, train_percent: int = 80) -> Column:
    """Stable train flag from a hash of the row key.

    Depends on the key only: unlike ``randomSplit`` it gives the same rows
    whatever the partitioning, and survives task retries.
    """
    bucket = F.conv(F.substring(F.md5(col(key)), 1, 6), 16, 10).cast("bigint") % 100
    return bucket < train_percent


def fold_of(key: str | Column, folds: int = 5) -> Column:
    """Stable cross-validation fold number from a hash of the row key."""
    return (F.conv(F.substring(F.md5(col(key)), 7, 6), 16, 10).cast("bigint") % folds).cast("int")


def sums(*names: str) -> list[Column]:
    """Order-independent sums under the columns' own names."""
    return [exact_sum(n).alias(n) for n in names]


def means(**aliases: str) -> list[Column]:
    """Means, as alias=column."""
    return [F.avg(c).alias(a) for a, c in aliases.items()]


def exact_mean(c: str | Column) -> Column:
    """Mean with the same bits in every evaluation of the plan.

    For values that are ranked, compared with quantiles of themselves or joined
    on. Added like ``exact_sum``, with twelve decimals.
    """
    c = col(c)
    return F.try_divide(_counted_sum(c), F.count(c).cast("double"))


def revenue() -> Column:
    return F.col("line_product_revenue") + F.col("line_freight_revenue")


def cost() -> Column:
    return F.col("line_product_cost") + F.col("line_freight_cost")


def product_profit() -> Column:
    return F.col("line_product_revenue") - F.col("line_product_cost")


def freight_profit() -> Column:
    return F.col("line_freight_revenue") - F.col("line_freight_cost")
