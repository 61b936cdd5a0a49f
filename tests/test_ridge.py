"""Ridge regressions with effects a level: against a plain solution of the whole system, and on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators.ridge import Target, fit_ridges, load_ridges
from tallyline.sources.scratch import bucketed, dropped

SCHEMA = "k int, g string, h string, x double, w double, y double"


def planted_rows(n: int = 400, seed: int = 7) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        g, h, x = int(rng.integers(0, 12)), int(rng.integers(0, 5)), float(rng.normal(50, 9))
        w = 0.5 * x + float(rng.normal(0, 3))
        rows.append((k, f"g{g}", f"h{h}", x, w, 3.0 * g - 2.0 * h + 0.7 * x - 0.2 * w + float(rng.normal())))
    return rows


def whole_system(rows: list[tuple], penalty: float = 1.0) -> np.ndarray:
    """Predictions of one ridge over standardised numbers and a column a level, the intercept not penalised."""
    x = np.array([[r[3], r[4]] for r in rows])
    x = (x - x.mean(0)) / x.std(0)
    levels = [[float(r[1] == f"g{i}") for i in range(12)] + [float(r[2] == f"h{i}") for i in range(5)] for r in rows]
    a = np.hstack([np.ones((len(rows), 1)), x, np.array(levels)])
    y = np.array([r[5] for r in rows])
    keep = penalty * np.eye(a.shape[1])
    keep[0, 0] = 0.0
    return a @ np.linalg.solve(a.T @ a + keep, a.T @ y)


def predictions(model, df, target="t"):
    return {r.k: r.p for r in model.predict(df, {target: "p"}).collect()}


def test_rounds_lead_to_the_whole_solution(spark):
    rows = planted_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    want, away = whole_system(rows), []
    for rounds in (1, 3, 8):
        got = predictions(fit_ridges(df, [Target("t", F.col("y"), ["x", "w"])], ["g", "h"], rounds), df)
        away.append(max(abs(got[r[0]] - p) for r, p in zip(rows, want)))
    assert away[0] > away[1] > away[2] and away[2] < 1e-3


def test_regressions_of_one_scan_equal_single_ones(spark):
    df = spark.createDataFrame(planted_rows(), SCHEMA)
    part = F.col("k") % 3 != 1
    first, second = Target("a", F.col("y"), ["x", "w"], part), Target("b", F.col("w"), ["x"])
    both = fit_ridges(df, [first, second], ["g", "h"], 2)
    alone = fit_ridges(df.where(part), [Target("a", F.col("y"), ["x", "w"])], ["g", "h"], 2)
    got, want = predictions(both, df, "a"), predictions(alone, df, "a")
    assert got == pytest.approx(want, abs=1e-8)
    other = predictions(fit_ridges(df, [Target("b", F.col("w"), ["x"])], ["g", "h"], 2), df, "b")
    assert predictions(both, df, "b") == pytest.approx(other, abs=1e-8)


def test_unseen_levels_missing_values_and_saving(spark, tmp_path):
    rows = [*planted_rows(), (900, None, "h1", 50.0, None, 20.0), (901, "g1", None, None, 25.0, 7.0), (902, "g1", "h1", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_ridges(df, [Target("t", F.col("y"), ["x", "w", "flat"])], ["g", "h"])
    known = sorted(r[3] for r in rows if r[3] is not None and r[5] is not None)
    assert model.fills["x"] == pytest.approx(float(np.median(known))) and model.fills["flat"] == 0.0
    assert model.lines["t"].slopes["flat"] == 0.0
    odd = spark.createDataFrame([(1, "never", "h1", 50.0, 20.0, None), (2, None, None, None, None, None)], SCHEMA)
    got = predictions(model, odd)
    assert all(p is not None and np.isfinite(p) for p in got.values())
    levels = {r.level: r.e0 for r in model.effects["g"].collect()}
    assert "missing" in levels and "never" not in levels
    line, x = model.lines["t"], {"x": 50.0, "w": 20.0}
    bare = line.intercept + sum(line.slopes[n] * (v - model.shifts[n]) for n, v in x.items())
    assert got[1] == pytest.approx(bare + {r.level: r.e0 for r in model.effects["h"].collect()}["h1"])
    model.save(spark, str(tmp_path / "model"))
    assert predictions(load_ridges(spark, str(tmp_path / "model")), df) == pytest.approx(predictions(model, df))
    assert model.predict(odd.withColumn("p", F.lit("old")), {"t": "p"}).columns == [*odd.columns, "p"]


def test_empty_and_unlabelled_tables_predict_zero(spark):
    df = spark.createDataFrame([(1, "g1", "h1", 1.0, 1.0, None)], SCHEMA)
    for table in (df, df.limit(0)):
        model = fit_ridges(table, [Target("t", F.col("y"), ["x"])], ["g"], 1)
        assert predictions(model, df) == {1: 0.0}


def test_many_levels_stay_apart(spark):
    df = spark.range(6000).select(
        F.col("id").cast("int").alias("k"), (F.col("id") % 2000).cast("string").alias("g"), F.lit("h").alias("h"),
        F.lit(1.0).alias("x"), F.lit(1.0).alias("w"), (F.col("id") % 2000).cast("double").alias("y"),
    )
    model = fit_ridges(df, [Target("t", F.col("y"), ["x"])], ["g"], 1, penalty=0.0)
    assert model.predict(df, {"t": "p"}).where("abs(p - y) > 1e-6").count() == 0


def test_rows_dealt_by_a_category_give_the_same_fit(spark):
    rows = [*planted_rows(), (900, None, "h1", 50.0, None, 20.0), (901, "g1", None, None, 25.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    y = F.col("y")
    targets = [Target("a", y, ["x", "w"]), Target("b", y, ["x", "w"], F.col("k") % 3 != 1), Target("c", "w", ["x"])]
    names, kept = spark.catalog.listTables(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = fit_ridges(df, [*targets[:2], Target("c", F.col("w"), ["x"])], ["g", "h"], 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = fit_ridges(df, targets, ["g", "h"], 2, dealt_by="g")
        for target in "abc":
            assert predictions(dealt, df, target) == pytest.approx(predictions(plain, df, target), abs=1e-8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert list(dealt.effects) == ["h", "g"] and spark.catalog.listTables() == names


def test_buckets_are_joined_and_summed_where_they_lie(spark, capsys):
    made = [bucketed(spark.range(50).select(F.col("id").cast("string").alias("level"), F.rand(1).alias(c)), "bucket-test", "level", 12)[0] for c in "ab"]
    try:
        joined = spark.table(made[0]).join(spark.table(made[1]).hint("shuffle_hash"), "level", "left")
        joined.groupBy("level").agg(F.sum("b")).explain()
        assert "Exchange" not in capsys.readouterr().out and joined.where("b IS NULL").count() == 0
    finally:
        dropped(spark, made)
