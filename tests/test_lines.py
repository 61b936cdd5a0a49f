"""Per-line rules on hand-made rows."""

import datetime as dt

import pytest
from fixtures import by, lines
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tallyline.operators import lines as li
from tallyline.schema import LINE_KEY, MEASURES, ORDER_LINES, fill_missing_columns, require_columns
from tallyline.sources.order_lines import normalise, read_csv, read_parquet


def test_zero_revenue_gives_zero_margin_and_minus_one_fraction(spark):
    df = lines(
        spark,
        {"line_product_revenue": 0.0},
        {"line_freight_revenue": 0.0},
        {"line_product_revenue": 0.0, "line_freight_revenue": 0.0},
    )
    percent = by(li.with_margins(df), LINE_KEY)
    assert percent["k00000"].product_margin == 0.0
    assert percent["k00001"].freight_margin == 0.0
    assert percent["k00002"].delivered_margin == 0.0
    fraction = by(li.line_margins_fraction(df), LINE_KEY)
    assert fraction["k00000"].product_margin == -1.0
    assert fraction["k00001"].freight_margin == -1.0
    assert fraction["k00002"].delivered_margin == -1.0


def test_fraction_of_nothing_and_of_missing_is_zero(spark):
    df = lines(
        spark,
        {"line_product_revenue": 0.0, "line_product_cost": 0.0},
        {"line_product_cost": None},
        {"line_product_revenue": 1.0, "line_product_cost": 500.0},
    )
    fraction = by(li.line_margins_fraction(df), LINE_KEY)
    assert [fraction[k].product_margin for k in sorted(fraction)] == [0.0, 0.0, -1.0]


def test_missing_cost_stays_missing_and_row_is_dropped(spark):
    df = lines(spark, {"line_product_cost": None}, {})
    assert by(li.with_margins(df), LINE_KEY)["k00000"].product_margin is None
    assert [r[LINE_KEY] for r in li.clean_lines(df).collect()] == ["k00001"]


def test_zero_quantity_is_dropped_without_error(spark):
    df = lines(spark, {"line_quantity": 0.0}, {})
    assert [r[LINE_KEY] for r in li.clean_lines(df).collect()] == ["k00001"]


@pytest.mark.parametrize("column", [f.name for f in ORDER_LINES if f.name != LINE_KEY])
def test_any_missing_column_drops_the_line(spark, column):
    assert li.clean_lines(lines(spark, {column: None}, {})).count() == 1


def test_weekday_counts_from_monday(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 6), dt.date(2024, 1, 7)]
    got = by(li.line_calendar(lines(spark, *({"order_date": d} for d in days))), LINE_KEY)
    assert [(r.day_of_week, r.is_weekend) for _, r in sorted(got.items())] == [(0, 0), (5, 1), (6, 1)]


def test_season_edges(spark):
    days = [dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2024, 12, 1), dt.date(2024, 1, 31), dt.date(2024, 8, 31)]
    got = by(li.line_calendar(lines(spark, *({"order_date": d} for d in days))), LINE_KEY)
    assert [r.season for _, r in sorted(got.items())] == ["Winter", "Spring", "Winter", "Winter", "Summer"]
    assert got["k00000"].month_start == dt.date(2024, 2, 1)
    assert got["k00000"].month_end == dt.date(2024, 2, 29)


def test_ratios_are_clipped_and_skip_absent_inputs(spark):
    df = li.with_margins(lines(spark, {"line_product_revenue": 9999.0}, {"line_product_cost": 0.0}))
    got = by(li.line_ratios(df), LINE_KEY)
    assert got["k00000"].revenue_to_cost_ratio == 10.0
    assert got["k00001"].revenue_to_cost_ratio == 0.0
    assert "revenue_to_cost_ratio" not in li.with_ratios(df.drop("line_product_cost")).columns


def test_freight_price_falls_back_to_product_revenue(spark):
    df = lines(spark, {"line_freight_cost": 0.0}, {}, {"line_quantity": 0.0})
    got = by(li.line_freight_price(df), LINE_KEY)
    assert (got["k00000"].freight_revenue, got["k00000"].price) == (15.0, 7.5)
    assert (got["k00001"].freight_revenue, got["k00001"].price) == (20.0, 10.0)
    assert got["k00002"].price is None


def test_required_columns(spark):
    df = lines(spark, {})
    with pytest.raises(ValueError, match="item_number, order_date"):
        require_columns(df.drop("order_date", "item_number"), ORDER_LINES.names)
    filled = fill_missing_columns(df.drop("line_quantity"), MEASURES)
    assert filled.first().line_quantity == 0.0


def test_csv_and_parquet_readers(spark, tmp_path):
    df = lines(spark, {}, {"line_quantity": 3.0})
    shuffled = df.select(*reversed(df.columns))
    shuffled.write.option("header", True).csv(str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert back.schema == ORDER_LINES
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    df.write.parquet(str(tmp_path / "pq"))
    assert read_parquet(spark, str(tmp_path / "pq")).count() == 2


def test_nan_and_infinity_become_missing(spark):
    df = lines(spark, {"line_product_cost": float("nan")}, {"line_freight_cost": float("inf")}, {})
    assert li.clean_lines(normalise(df)).count() == 1


def test_margin_transformer_survives_saving(spark, tmp_path):
    model = Pipeline(stages=[li.MarginColumns()]).fit(lines(spark, {}))
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(lines(spark, {}))
    assert again.first().product_margin == pytest.approx(40.0)


def test_model_inputs_drop_identifiers(spark):
    assert "customer_name" not in li.model_inputs(lines(spark, {})).columns


def test_filters_reach_the_scan(spark, tmp_path):
    lines(spark, {}).write.parquet(str(tmp_path / "pq"))
    plan = li.clean_lines(spark.read.parquet(str(tmp_path / "pq"))).filter(F.col("order_region") == "north").agg(
        F.sum("total_revenue")
    )
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(order_region,north)" in text
    assert "IsNotNull(customer_name)" in text


def test_sums_keep_small_and_large_values(spark):
    from tallyline.functions.columns import exact_sum

    small = spark.range(1000).select(F.lit(4e-7).alias("v"))
    assert small.agg(exact_sum("v")).first()[0] == pytest.approx(4e-4, rel=1e-12)
    mixed = spark.createDataFrame([(1e16,), (-2.75,), (0.1,), (None,)], "v double")
    assert mixed.agg(exact_sum("v")).first()[0] == pytest.approx(1e16 - 2.65, rel=1e-15)
