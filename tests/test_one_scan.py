"""Encodings and drill-downs: what goes through the shuffle and how often the lines are read."""

import pytest
from conftest import SF
from fixtures import by, lines

from tallyline.operators import drilldown as dr
from tallyline.operators import models as mo
from tallyline.operators.lines import with_margins
from tallyline.schema import LINE_KEY
from tallyline.sources.order_lines import star_view

ROWS = (
    {"category_1": "x", "customer_agreement": None},
    {"category_1": "x", "line_product_revenue": 200.0, "customer_name": None},
    {"category_1": None, "line_product_revenue": 300.0},
    {"category_1": "v", "line_product_cost": None},
)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_encodings_read_the_lines_once_for_all_means(spark):
    df = with_margins(lines(spark, *ROWS))
    encoded = mo.target_encode(df, ("category_1", "customer_agreement"))
    got = by(encoded, LINE_KEY)
    margin = {k: r.delivered_margin for k, r in got.items()}
    x = (margin["k00000"] + margin["k00001"]) / 2
    assert [got[k].category_1_encoded for k in sorted(got)] == [pytest.approx(x), pytest.approx(x), None, None]
    assert got["k00000"].customer_agreement_encoded is None
    assert got["k00003"].customer_agreement_encoded == pytest.approx((margin["k00001"] + margin["k00002"]) / 2)
    assert plan_of(encoded).count("LogicalRDD") == 1


def test_members_are_found_without_sums(spark):
    found = dr.item_drilldown(with_margins(lines(spark, *ROWS)))
    only = found.where("member_column IS NOT NULL")
    assert "sum(" not in plan_of(only)
    x = [r for r in found.collect() if r.category_column == "category_1" and r.category_value == "x"]
    assert sorted((r.member_column, r.member) for r in x if r.member_column) == [
        ("customer_agreement", "a1"), ("customer_name", "c1"), ("order_region", "north"),
    ]
    (total,) = [r for r in x if r.member_column is None]
    assert total.line_product_revenue == 300.0 and total.member is None
    assert all(r.line_product_revenue is None for r in x if r.member_column)


def outermost_join(df, capsys):
    """The first join that the plan shows: the last one made."""
    df.explain()
    return next(line for line in capsys.readouterr().out.splitlines() if "Join" in line)


def test_codes_of_the_column_with_most_values_are_joined_last(spark, capsys):
    rows = [(f"m{i}", f"f{i % 3}" if i else None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "many string, few string, k int")
    coded = mo.category_codes(df, ["many", "few"])
    assert "many" in outermost_join(coded, capsys) and coded.columns == ["few", "many", "k", "many_code", "few_code"]
    levels = sorted(r[0] for r in rows)
    assert {r.k: (r.many_code, r.few_code) for r in coded.collect()} == {i: (levels.index(m), int(f[1]) if f else -1) for m, f, i in rows}


def test_parts_meet_the_lines_last(spark, capsys):
    assert "partkey" in outermost_join(star_view(spark, SF), capsys)
