"""Order-dependent helpers give the same exact results however groups are cut."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyline.operators import grouping as g
from tallyline.operators.agreements import average_rank
from tallyline.operators.models import category_codes

PROBS = [0.0, 0.05, 0.25, 0.5, 2 / 3, 0.95, 1.0]


def skewed(spark, rows=3000, seed=7):
    """A third of all rows under one key; values with many ties."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 1 / 3, "hot", rng.integers(0, 40, rows).astype(str))
    pdf = pd.DataFrame({"k": key, "id": np.arange(rows), "v": np.round(rng.normal(0, 50, rows), 1)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("accuracy,cells", [(10, 5), (100, 1000), (10_000, 1_000)])
def test_table_quantiles(spark, accuracy, cells):
    pdf, df = skewed(spark)
    pdf["w"] = np.where(pdf.id % 3 == 0, 5.0, pdf.v ** 3)
    df = df.withColumn("w", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("v") * F.col("v") * F.col("v")))
    got = {r.metric: r.quantiles for r in g.table_quantiles(df, ["v", "w"], PROBS, accuracy, cells).collect()}
    for c in ("v", "w"):
        assert got[c] == pytest.approx(list(np.quantile(pdf[c], PROBS)), abs=1e-9)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.just(3.0)), min_size=1, max_size=60))
def test_table_quantiles_any_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None]
    got = g.table_quantiles(df, ["v"], [0.25, 0.5, 0.75], 10, 4).collect()
    if not known:
        assert got == []
    else:
        assert got[0].quantiles == pytest.approx(list(np.quantile(known, [0.25, 0.5, 0.75])), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("split_rows", [20, 10**9])
def test_exact_quantiles_by_key(spark, split_rows):
    pdf, df = skewed(spark)
    got = {r.k: r.quantiles for r in g.exact_quantiles(df, "v", PROBS, ["k"], split_rows=split_rows).collect()}
    assert len(got) == pdf.k.nunique()
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx(list(np.quantile(part.v, PROBS)), abs=1e-9)


@pytest.mark.parametrize("split_rows", [20, 10**9])
def test_weighted_quantiles(spark, split_rows):
    pdf, df = skewed(spark, 800)
    weight = pdf.id % 4 + 1
    got = g.exact_quantiles(df, "v", PROBS, weight=F.col("id") % 4 + 1, split_rows=split_rows).first().quantiles
    assert got == pytest.approx(list(np.quantile(np.repeat(pdf.v, weight), PROBS)), abs=1e-9)


@pytest.mark.parametrize("back", [1, 6])
@pytest.mark.parametrize("split_rows", [8, 30, 10**9])
def test_lookback_windows(spark, back, split_rows):
    pdf, df = skewed(spark)
    cut = g.with_lookback(df, ["k"], ["v", "id"], back, split_rows)
    w = Window.partitionBy("k", "_part").orderBy("v", "id").rowsBetween(-back, 0)
    got = cut.withColumn("s", F.sum("id").over(w)).filter(~F.col("_halo")).select("id", "s").toPandas()
    want = pdf.sort_values(["v", "id"])
    want["s"] = want.groupby("k")["id"].transform(lambda x: x.rolling(back + 1, min_periods=1).sum())
    merged = got.merge(want, on="id")
    assert len(got) == len(pdf) and (merged.s_x == merged.s_y).all()


def test_hot_groups_are_cut_and_others_are_not(spark):
    _, df = skewed(spark)
    parts = g.split_groups(df, ["k"], ["v", "id"], 100)
    sizes = parts.groupBy("k").agg(F.max("_part").alias("p"), F.max(F.col("_hot").cast("int")).alias("h")).collect()
    assert {r.k for r in sizes if r.p > 0} == {"hot"}
    assert {r.k for r in sizes if r.h} == {"hot"}
    assert g.heavy_keys(df, ["k"], 10**9) is None


def test_no_cut_leaves_a_plain_plan(spark):
    _, df = skewed(spark)
    plan = g.exact_quantiles(df, "v", [0.5], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("split_rows", [20, 10**9])
def test_average_rank(spark, split_rows):
    pdf, df = skewed(spark, 500)
    got = average_rank(df, "v", "r", split_rows).select("id", "r").toPandas().set_index("id").r.sort_index()
    want = pdf.set_index("id").v.rank(ascending=False)
    assert (got == want).all()


@pytest.mark.parametrize("split_rows", [5, 10**9])
def test_category_codes(spark, split_rows):
    pdf, df = skewed(spark, 500)
    df = df.withColumn("k", F.when(F.col("id") % 50 != 0, F.col("k")))
    got = category_codes(df, ["k"], split_rows).select("id", "k_code").toPandas().set_index("id").k_code.sort_index()
    want = pdf.k.where(pdf.id % 50 != 0).astype("category").cat.codes
    assert (got.to_numpy() == want.to_numpy()).all()


def test_top_per_group_prunes_before_the_shuffle(spark):
    _, df = skewed(spark)
    top = g.top_per_group(df, ["k"], [F.desc("v"), F.asc("id")], 2)
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 2
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_table_quantiles_of_few_rows(spark):
    for n in (1, 2, 5, 200):
        values = [float((7 * i) % n) for i in range(n)]
        got = g.table_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], [0.2, 1 / 3, 2 / 3, 0.8]).first()
        assert got.quantiles == pytest.approx(pd.Series(values).quantile([0.2, 1 / 3, 2 / 3, 0.8]).tolist())
