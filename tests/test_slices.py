"""Jobs in slices of their rows: the same rows as in one go, and no shuffle files of more than one slice."""

import os

import pytest
from conftest import SF
from fixtures import lines

from tallyline.operators import drilldown as dr
from tallyline.operators import models as mo
from tallyline.operators import pricing, ridge
from tallyline.operators.lines import clean_lines, enriched_lines
from tallyline.plans import queries
from tallyline.schema import LINE_KEY
from tallyline.sources import drilldown as ds
from tallyline.sources import scratch

# Keys that are missing, lines that come twice, an item in two categories.
ROWS = [
    *({"item_number": f"i{k % 5}", "category_1": f"x{k % 3}", "customer_name": f"c{k}", "order_number": f"o{k % 7}"} for k in range(30)),
    {"item_number": None}, {"category_1": None, "customer_name": None}, {"item_number": "i1", "line_product_cost": None},
    {"item_number": "i2"}, {"item_number": "i2"},
]


def many(spark, tmp_path, *rows):
    """Hand-made lines as a table of known size."""
    lines(spark, *(rows or ROWS)).write.parquet(str(tmp_path / "lines"))
    return spark.read.parquet(str(tmp_path / "lines"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def sorted_rows(df):
    return sorted(df.collect(), key=str)


@pytest.fixture(autouse=True)
def few(monkeypatch):
    """Few slices and buckets, as the rows are few."""
    monkeypatch.setattr(scratch, "MOST_SLICES", 3)
    monkeypatch.setattr(ridge, "BUCKETS", 4)


@pytest.fixture
def in_parts(monkeypatch):
    """Every table of known size counts as large."""
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)


def test_slices_have_every_row_once(spark, tmp_path, in_parts):
    df = many(spark, tmp_path)
    parts = scratch.sliced(df, "item_number")
    assert len(parts) == scratch.MOST_SLICES
    keys = [r[0] for p in parts for r in p.select(LINE_KEY).collect()]
    assert sorted(keys) == sorted(r[0] for r in df.select(LINE_KEY).collect())
    assert sum(1 for p in parts if p.where("item_number IS NULL").count()) == 1


def test_small_and_unknown_inputs_stay_one_plan(spark, tmp_path):
    df = many(spark, tmp_path)
    assert 0 < scratch.input_bytes(df) < scratch.SLICE_BYTES and len(scratch.sliced(df, "item_number")) == 1
    assert scratch.input_bytes(lines(spark, *ROWS)) == 0


def test_item_drilldown_in_slices(spark, tmp_path, in_parts):
    ol = enriched_lines(many(spark, tmp_path))
    found = queries._item_drilldown(ol)
    assert "Aggregate" not in plan_of(found)
    assert found.dtypes == dr.item_drilldown(ol).dtypes and sorted_rows(found) == sorted_rows(dr.item_drilldown(ol))


def test_gaps_drilldown_in_slices(spark, in_parts):
    found = queries.SQL_CHECKED["item_drilldown_gaps"](spark, SF)
    whole = queries.on_gaps(dr.item_drilldown)(spark, SF)
    assert "Aggregate" not in plan_of(found) and sorted_rows(found) == sorted_rows(whole)


def test_drilldown_files_in_slices(spark, tmp_path, in_parts, monkeypatch):
    made = []
    kept = scratch.scratch_dir
    monkeypatch.setattr(queries, "scratch_dir", lambda *x: made.append(kept(*x)) or made[-1])
    found = queries.SQL_CHECKED["read_drilldown"](spark, SF)
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1 << 28)
    assert sorted_rows(found) == sorted_rows(queries.SQL_CHECKED["read_drilldown"](spark, SF))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(made[0]).select("path").collect()
    assert files and all(f.path.endswith(".csv.gz") for f in files)
    whole = ds.read_drilldown(spark, made[1])
    assert sorted_rows(ds.read_drilldown(spark, made[0])) == sorted_rows(whole) and whole.select("category_column").distinct().count() == 3


def test_line_predictions_in_slices(spark, tmp_path, monkeypatch):
    ol = clean_lines(many(spark, tmp_path))
    want = {r[0]: r[1:] for r in queries._line_predictions(ol).collect()}
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)
    names, folders = spark.catalog.listTables(), []
    kept = scratch.scratch_dir
    monkeypatch.setattr(scratch, "scratch_dir", lambda *x: folders.append(kept(*x)) or folders[-1])
    found = queries._line_predictions(ol)
    assert "Join" not in plan_of(found)
    assert {r[0]: r[1:] for r in found.collect()} == {k: pytest.approx(v) for k, v in want.items()}
    rows = [f.removeprefix("file://") for f in folders if "ridge-rows" in f]
    assert len(rows) == 1 and not any(os.path.exists(f) for f in rows) and spark.catalog.listTables() == names


def test_customer_segments_in_slices(spark, tmp_path, monkeypatch):
    ol = clean_lines(many(spark, tmp_path))
    want = sorted_rows(queries._predicted(ol))
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)
    found = queries._predicted(ol)
    assert "Join" not in plan_of(found) and len(want) == found.count()
    assert [x for r in sorted_rows(found) for x in r[1:]] == pytest.approx([x for r in want for x in r[1:]])


def test_margin_regressor_cv_in_slices(spark, tmp_path, monkeypatch):
    ol = clean_lines(many(spark, tmp_path))
    want = mo.margin_regressor_cv(ol, 3)[2].first()
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)
    scores = mo.margin_regressor_cv(ol, 3)[2]
    assert "Join" not in plan_of(scores)
    assert [x is None for x in scores.first()] == [x is None for x in want]
    assert [x for x in scores.first() if x is not None] == pytest.approx([x for x in want if x is not None])


def test_scenario_scores_in_slices(spark, tmp_path, monkeypatch):
    ol = clean_lines(many(spark, tmp_path))
    want = {r[0]: r.score for r in queries._scored(ol).collect()}
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)
    monkeypatch.setattr(pricing, "MOST_SLICES", 1)
    found = queries._scored(ol)
    assert "Join" not in plan_of(found) and {r[0]: r.score for r in found.collect()} == pytest.approx(want)
    assert found.count() == len(want) == ol.count()


def test_scores_of_lines_that_come_twice(spark, tmp_path, in_parts, monkeypatch):
    monkeypatch.setattr(pricing, "MOST_SLICES", 1)
    once = clean_lines(many(spark, tmp_path, *ROWS[:6]))
    twice = once.unionAll(once)
    twice.write.parquet(str(tmp_path / "twice"))
    found = queries._scored(spark.read.parquet(str(tmp_path / "twice")))
    assert sorted(found.groupBy(LINE_KEY).count().select("count").distinct().collect()) == [(4,)]


def test_model_scores_in_slices(spark, tmp_path, monkeypatch):
    ol = clean_lines(many(spark, tmp_path))
    want = {r[0]: r.score for r in queries._scenario_score_models(ol).collect()}
    monkeypatch.setattr(scratch, "SLICE_BYTES", 1)
    monkeypatch.setattr(pricing, "MOST_SLICES", 1)
    found = queries._scenario_score_models(ol)
    assert "Join" not in plan_of(found) and {r[0]: r.score for r in found.collect()} == pytest.approx(want, abs=1e-6)
    assert len(want) == ol.count()
