"""Order-dependent work on groups of any size.

Windows and exact percentiles normally sort a whole group in one task, so one
hot key stalls the job. Here a group that holds more than its share of rows is
cut into consecutive parts along its sort order; every part is sorted by its
own task and the few values that cross a cut are passed on explicitly. Results
are exact and do not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from types import EllipsisType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A group is heavy when it has more than SPLIT_ROWS rows and more than
# 1/MAX_SHARE of all rows. At most MAX_SHARE groups can qualify, and about
# MAX_SHARE cuts are made in total: that bounds what is collected and broadcast.
SPLIT_ROWS = 250_000
MAX_SHARE = 2_000

# Heavy keys with the row limit, None for "there are none", ... for "not looked up yet".
HeavyKeys = tuple[DataFrame, int] | EllipsisType | None


def split_limit(total_rows: int, split_rows: int | None = None) -> int:
    """Most rows a group may have before it is cut."""
    return max(split_rows or SPLIT_ROWS, total_rows // MAX_SHARE)


def heavy_keys(df: DataFrame, keys: Sequence[str], split_rows: int | None = None) -> HeavyKeys:
    """Keys whose groups must be cut, with the row limit; None when there are none.

    One aggregation with map-side combine; only the at most MAX_SHARE heavy
    keys reach the driver.
    """
    keys = list(keys)
    if not keys:
        rows = df.count()
        limit = split_limit(rows, split_rows)
        return None if rows <= limit else (df.sparkSession.range(0), limit)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_total"))
    least = F.greatest(F.lit(split_rows or SPLIT_ROWS), F.floor(total.scalar() / F.lit(MAX_SHARE)))
    found = sizes.filter(F.col("_rows") > least).select(*keys, least.cast("bigint").alias("_least")).collect()
    if not found:
        return None
    schema = df.select(*keys).schema
    local = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in found], schema)
    return local, found[0]["_least"]


def has_large_groups(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> bool:
    """Whether any key has more than ``rows`` rows."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return not sizes.filter(F.col("_rows") > (rows or SPLIT_ROWS)).limit(1).isEmpty()


def split_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    split_rows: int | None = None,
    heavy: HeavyKeys = ...,
) -> DataFrame:
    """Add ``_part`` (0, 1, ... along ``order``) and ``_hot`` (group was cut).

    ``order`` must be unique within ``keys`` and free of NULLs. Cut points are
    rows picked by a hash of their values, so they follow the data distribution;
    they enter the plan as literals, so retried tasks see the same cuts.
    ``heavy`` is a result of ``heavy_keys``, where it is known already.
    """
    keys, order = list(keys), list(order)
    if heavy is ...:
        heavy = heavy_keys(df, keys, split_rows)
    if heavy is None:
        return df.withColumn("_part", F.lit(0)).withColumn("_hot", F.lit(False))
    names, limit = heavy
    position = F.struct(*order)
    sample = df.select(*keys, *order).filter(F.pmod(F.xxhash64(*keys, *order), F.lit(limit)) == 0)
    if keys:
        sample = sample.join(F.broadcast(names), keys, "left_semi")
    points = sample.groupBy(*keys).agg(F.array_sort(F.collect_list(position)).alias("_cuts"))
    local = df.sparkSession.createDataFrame(points.collect(), points.schema)
    if keys:
        cut = df.join(F.broadcast(local), keys, "left")
    else:
        cut = df.withColumn("_cuts", local.scalar())
    before = F.size(F.filter("_cuts", lambda c: c < position))
    return (
        cut.withColumn("_part", F.when(F.size("_cuts") > 0, before).otherwise(0))
        .withColumn("_hot", F.coalesce(F.size("_cuts") > 0, F.lit(False)))
        .drop("_cuts")
    )


def part_offsets(parts: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Weight before each part and weight of the whole group, for cut groups."""
    keys = list(keys)
    totals = parts.filter("_hot").groupBy(*keys, "_part").agg(F.sum(weight).alias("_own"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_own").over(running), F.lit(0)).alias("_before"),
        F.sum("_own").over(group).alias("_total"),
    )


def with_positions(
    hist: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: str,
    split_rows: int | None = None,
    heavy: HeavyKeys = ...,
) -> DataFrame:
    """Add ``_first`` and ``_last``, the 0-based positions each distinct value
    covers in its sorted group, and ``_size``, the total weight of the group."""
    keys = list(keys)
    parts = split_groups(hist, keys, [order], split_rows, heavy)
    ordered = Window.partitionBy(*keys, "_part").orderBy(order)
    running = parts.withColumn(
        "_upto", F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn(
        "_all",
        F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    )
    offsets = part_offsets(parts, keys, weight)
    joined = running.join(F.broadcast(offsets), [*keys, "_part"], "left")
    last = F.coalesce("_before", F.lit(0)) + F.col("_upto") - 1
    return joined.select(
        *hist.columns,
        (last - F.col(weight) + 1).alias("_first"),
        last.alias("_last"),
        F.coalesce("_total", "_all").alias("_size"),
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    weight: Column | None = None,
    split_rows: int | None = None,
    heavy: HeavyKeys = ...,
) -> DataFrame:
    """Linear-interpolation quantiles: ``by`` columns plus an array ``quantiles``.

    Rows are first reduced to distinct values with counts, then positions are
    found part by part; no task sees a whole large group. ``weight`` counts a
    row that many times. For unweighted quantiles of a whole table see
    ``table_quantiles``, which shuffles far less.
    """
    by = list(by)
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    hist = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_value"))
        .agg(count.cast("bigint").alias("_n"))
    )
    placed = with_positions(hist, by, "_value", "_n", split_rows, heavy)
    wanted = [F.col("_size") - 1 if p == 1 else (F.col("_size") - 1) * F.lit(float(p)) for p in probabilities]

    def covers(position: Column) -> Column:
        return (F.col("_first") <= position) & (position <= F.col("_last"))

    picks, useful = [], F.lit(False)
    for i, position in enumerate(wanted):
        low, high = covers(F.floor(position)), covers(F.ceil(position))
        useful = useful | low | high
        picks += [
            F.max(F.when(low, F.col("_value"))).alias(f"_low{i}"),
            F.max(F.when(high, F.col("_value"))).alias(f"_high{i}"),
            F.max(F.when(low, position - F.floor(position))).alias(f"_frac{i}"),
        ]
    found = placed.filter(useful).groupBy(*by).agg(*picks)
    return found.select(
        *by,
        F.array(
            *(
                F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_frac{i}")
                for i in range(len(probabilities))
            )
        ).alias("quantiles"),
    )


def table_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int = 10_000,
    cells: int = 1_000,
) -> DataFrame:
    """Exact linear-interpolation quantiles of whole columns.

    One row per column: ``metric`` and the array ``quantiles``.

    A first pass takes mergeable sketches that bracket every wanted position
    within 1/``accuracy`` of the rows. The second pass counts what lies below
    the brackets and keeps only the values inside them, so about
    4/``accuracy`` of the rows are shuffled; those are spread over ``cells``
    equal-width cells and only the cells that hold a wanted position are
    sorted.
    """
    margin = 2.0 / accuracy
    columns = list(columns)
    low_p = [max(p - margin, 0.0) for p in probabilities]
    high_p = [min(p + margin, 1.0) for p in probabilities]

    def sketch(c: str) -> Column:
        # Below this many rows a bracket may be narrower than two neighbours.
        whole = F.array(*[F.min(c)] * k, *[F.max(c)] * k)
        return F.when(F.count(c) < 2 * accuracy, whole).otherwise(F.percentile_approx(c, low_p + high_p, accuracy))

    k = len(probabilities)
    edges = df.agg(F.array(*(sketch(c) for c in columns)).alias("of"))
    values = F.array(*(F.struct(F.lit(i).alias("m"), F.col(c).alias("v")) for i, c in enumerate(columns)))
    long = df.select(F.explode(values).alias("_x")).select("_x.m", "_x.v").filter(F.col("v").isNotNull())
    v, e = F.col("v"), F.col("_e")
    slot = sum((F.when(e[k + j] < v, 1).otherwise(0) for j in range(k)), F.lit(0))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for j in reversed(range(k)):
        low = F.when(v <= e[k + j], e[j]).otherwise(low)
        high = F.when(v <= e[k + j], e[k + j]).otherwise(high)
    placed = (
        with_row(long, edges, "_edges")
        .select("m", "v", F.col("_edges.of")[F.col("m")].alias("_e"))
        .select("m", "v", slot.alias("slot"), low.alias("low"), high.alias("high"))
    )
    inside = F.coalesce(v >= F.col("low"), F.lit(False))
    cell = F.coalesce(
        F.floor(F.try_divide(v - F.col("low"), F.col("high") - F.col("low")) * F.lit(float(cells))), F.lit(0)
    )
    hist = (
        placed.select(
            "m", "slot", F.when(inside, cell).otherwise(-1).alias("cell"), F.when(inside, v).alias("v")
        )
        .groupBy("m", "slot", "cell", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    along = Window.partitionBy("m").orderBy("slot", "cell")
    totals = (
        hist.groupBy("m", "slot", "cell")
        .agg(F.sum("n").alias("own"))
        .withColumn("before", F.sum("own").over(along) - F.col("own"))
        .withColumn("size", F.sum("own").over(Window.partitionBy("m")))
    )
    wanted = [
        (F.col("size") - 1) if p == 1 else (F.col("size") - 1) * F.lit(float(p)) for p in probabilities
    ]

    def touches(first: Column, last: Column) -> Column:
        hit = F.lit(False)
        for pos in wanted:
            for end in (F.floor(pos), F.ceil(pos)):
                hit = hit | ((first <= end) & (end <= last))
        return hit

    # At most two cells per column and probability.
    needed = totals.filter(touches(F.col("before"), F.col("before") + F.col("own") - 1)).drop("own")
    within = Window.partitionBy("m", "slot", "cell").orderBy("v")
    ranked = (
        hist.join(F.broadcast(needed), ["m", "slot", "cell"])
        .withColumn("last", F.col("before") + F.sum("n").over(within) - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
        .filter(touches(F.col("first"), F.col("last")))
    )

    def at(end: Column) -> Column:
        return F.max(F.when((F.col("first") <= end) & (end <= F.col("last")), F.col("v")))

    found = ranked.groupBy("m", "size").agg(
        *(at(F.floor(pos)).alias(f"low{i}") for i, pos in enumerate(wanted)),
        *(at(F.ceil(pos)).alias(f"high{i}") for i, pos in enumerate(wanted)),
    )
    missed = F.lit("a sketch missed the wanted position")
    values = (
        F.when(F.col(f"low{i}").isNull() | F.col(f"high{i}").isNull(), F.raise_error(missed).cast("double")).otherwise(
            F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * (pos - F.floor(pos))
        )
        for i, pos in enumerate(wanted)
    )
    names = F.array(*(F.lit(c) for c in columns))
    return found.select(F.element_at(names, F.col("m") + 1).alias("metric"), F.array(*values).alias("quantiles"))


def quantile_row(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``table_quantiles`` as one row: a map from column to its quantiles."""
    entries = F.collect_list(F.struct("metric", "quantiles"))
    return table_quantiles(df, columns, probabilities).agg(F.map_from_entries(entries).alias("of"))


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """Add a one-row table as the struct column ``name``, read as a scalar subquery."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def with_lookback(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    split_rows: int | None = None,
    heavy: HeavyKeys = ...,
) -> DataFrame:
    """Make ``partitionBy(*keys, "_part")`` windows see ``rows`` rows back.

    Adds ``_part`` and ``_halo``: the last ``rows`` rows before a cut are
    repeated, flagged, at the head of the next part. Filter ``_halo`` rows away
    after the window.
    """
    keys, order = list(keys), list(order)
    parts = split_groups(df, keys, order, split_rows, heavy)
    payload = [c for c in df.columns if c not in keys and c not in order]
    newest = Window.partitionBy(*keys, "_part").orderBy(*(F.col(c).desc() for c in order))
    tails = (
        parts.filter("_hot")
        .withColumn("_k", F.row_number().over(newest))
        .filter(F.col("_k") <= rows)
        .groupBy(*keys, "_part")
        .agg(F.array_sort(F.collect_list(F.struct(*order, *payload))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(-rows, -1)
    halo = tails.select(
        *keys,
        "_part",
        F.flatten(F.collect_list("_tail").over(earlier)).alias("_prior"),
    ).select(
        *keys,
        "_part",
        F.explode(F.slice("_prior", F.greatest(F.size("_prior") - rows + 1, F.lit(1)), rows)).alias("_row"),
    )
    repeated = halo.select(
        *(F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns),
        "_part",
        F.lit(True).alias("_halo"),
    )
    return parts.drop("_hot").withColumn("_halo", F.lit(False)).unionByName(repeated)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key.

    The rank filter lets Spark cut every map task to ``n`` rows per key before
    the shuffle (WindowGroupLimit), so hot keys stay small.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= n).drop("_rank")


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Bring per-key values onto rows.

    ``per_key`` has one row per key. AQE broadcasts it when its measured size
    is small and splits hot keys of ``df`` in the sort-merge join otherwise.
    """
    return df.join(per_key, list(keys), how)
