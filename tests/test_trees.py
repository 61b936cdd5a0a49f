"""Trees against a recursive plain version; the same fit in one task, over the cluster and in two halves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import trees


def plain(x, target, weight, depth, penalty, least_gain):
    out = np.zeros(len(target))

    def rec(rows, left):
        own = rows[weight[rows] > 0]
        total, sum_ = weight[own].sum(), (weight * target)[own].sum()
        best = (least_gain, None, None)
        if left and target[own].min() < target[own].max():
            for j in range(x.shape[1]):
                levels = np.unique(x[own, j])
                for a, b in zip(levels[:-1], levels[1:]):
                    low = x[own, j] <= (a + b) / 2
                    parts = [own[low], own[~low]]
                    gain = sum((weight * target)[p].sum() ** 2 / (weight[p].sum() + penalty) for p in parts) - sum_**2 / (total + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, j, (a + b) / 2)
        if best[1] is None:
            out[rows] = sum_ / (total + penalty)
        else:
            low = x[rows, best[1]] <= best[2]
            rec(rows[low], left - 1)
            rec(rows[~low], left - 1)

    rec(np.arange(len(target)), depth)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_a_tree_is_the_plain_one(seed):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.integers(0, 6, 150).astype(float), r.normal(size=150), np.ones(150), r.integers(0, 2, 150).astype(float)])
    target, weight = r.normal(size=150) + x[:, 0], r.poisson(1, 150).astype(float) if seed % 2 else np.ones(150)
    arguments = (x, target, weight, 1 + seed * 2, float(seed % 3), 1e-6)
    assert trees.grow(*arguments)[0] == pytest.approx(plain(*arguments))


def test_odd_inputs():
    one = np.ones((3, 1))
    values, nodes = trees.grow(one, np.array([1.0, 2.0, 3.0]), np.ones(3), 5, 0.0, 0.0)
    assert values.tolist() == [2, 2, 2] and nodes[1].tolist() == [-1]
    assert trees.grow(one, np.array([1.0, 2.0, 3.0]), np.zeros(3), 5, 0.0, 0.0)[0].tolist() == [0, 0, 0]
    deep = trees.grow(np.arange(400.0).reshape(-1, 1), np.arange(400) % 2 * 1.0, np.ones(400), 30, 0.0, 0.0)[1]
    assert len(set(deep[0].tolist())) == len(deep[0]) and (deep[0] > 0).all()


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(7)
    x = np.column_stack([r.integers(0, 30, 3000).astype(float), r.normal(size=3000), np.zeros(3000), r.normal(size=3000)])
    target = x[:, 0] + 3 * (x[:, 1] > 0.3) * x[:, 3]
    data = [(k, k * 7919, bool(k % 5), float(t), v.tolist()) for k, (t, v) in enumerate(zip(target, x))]
    return spark.createDataFrame(data, "row long, key long, is_train boolean, target double, x array<double>").repartition(4).cache()


def walked(nodes, rows, tree):
    """Values by following the nodes from the root."""
    table = {n["node"]: n for n in nodes if n["tree"] == tree}
    found = {}
    for r in rows:
        at = 1
        while table[at]["feature"] is not None:
            at = 2 * at + (r["x"][table[at]["feature"]] > table[at]["threshold"])
        found[r["row"]] = table[at]["value"]
    return found


@pytest.mark.parametrize("task_rows", [1 << 17, 300])
def test_forest(rows, monkeypatch, task_rows):
    monkeypatch.setattr(trees, "TASK_ROWS", task_rows)
    predicted, nodes = trees.forest(rows, 5, 30, 1)
    found = {r["row"]: r["prediction"] for r in predicted.collect()}
    held_out = rows.where("NOT is_train").collect()
    nodes = nodes.collect()
    ways = [walked(nodes, held_out, tree) for tree in range(5)]
    assert found == pytest.approx({r["row"]: np.mean([w[r["row"]] for w in ways]) for r in held_out})
    assert len({(n["tree"], n["node"]) for n in nodes}) == len(nodes)
    target = {r["row"]: r["target"] for r in held_out}
    errors = np.array([found[k] - target[k] for k in target])
    assert 1 - (errors**2).mean() / np.var(list(target.values())) > 0.97


@pytest.mark.parametrize("task_rows", [1 << 17, 1500])
def test_boosting_goes_on_where_it_stopped(rows, monkeypatch, task_rows):
    monkeypatch.setattr(trees, "TASK_ROWS", task_rows)
    state = rows.withColumn("prediction", F.lit(14.0))
    whole, nodes = trees.boosted(state, 0, 4, 4, 0.4)
    half, first = trees.boosted(state, 0, 2, 4, 0.4)
    rest, second = trees.boosted(half, 2, 2, 4, 0.4)
    in_one, in_two = ({r["row"]: r["prediction"] for r in x.collect()} for x in (whole, rest))
    assert in_one == pytest.approx(in_two, abs=1e-9)
    nodes, parts = ({(n["tree"], n["node"]): n["feature"] for n in x.collect()} for x in (nodes, first.union(second)))
    assert nodes == parts and {t for t, _ in nodes} == set(range(4))
    target = {r["row"]: (r["target"], r["is_train"]) for r in rows.collect()}
    errors = [(in_one[k] - t) ** 2 for k, (t, train) in target.items() if not train]
    assert np.mean(errors) < 0.3 * np.var([t for t, train in target.values() if not train])


def test_boosting_matches_the_plain_version(rows):
    data = sorted(rows.limit(200).collect(), key=lambda r: r["row"])
    few = rows.join(rows.sparkSession.createDataFrame([(r["row"],) for r in data], "row long"), "row")
    state, _ = trees.boosted(few.withColumn("prediction", F.lit(10.0)), 0, 3, 3, 0.5)
    x, target = np.array([r["x"] for r in data]), np.array([r["target"] for r in data])
    weight, prediction = np.array([float(r["is_train"]) for r in data]), np.full(200, 10.0)
    for _ in range(3):
        prediction += 0.5 * plain(x, target - prediction, weight, 3, 1.0, 1e-6)
    assert [r["prediction"] for r in state.orderBy("row").collect()] == pytest.approx(prediction.tolist())


def test_a_node_without_a_cut_is_a_leaf_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    data = [(k, k, k % 4 > 0, float(k % 2), [1.0, 5.0]) for k in range(100)]
    rows = spark.createDataFrame(data, "row long, key long, is_train boolean, target double, x array<double>")
    state, nodes = trees.boosted(rows.withColumn("prediction", F.lit(0.0)), 0, 1, 5, 1.0)
    assert [n["feature"] for n in nodes.collect()] == [None]
    assert {round(r["prediction"], 9) for r in state.collect()} == {round(50 / 76, 9)}


def test_levels_write_no_rows_and_rows_in_one_part_are_dealt(rows, monkeypatch):
    tables = []

    def noted(df, name):
        tables.append((name, written(df, name)))
        return tables[-1][1]

    written = trees.written
    monkeypatch.setattr(trees, "TASK_ROWS", 300)
    monkeypatch.setattr(trees, "PART_ROWS", 300)
    monkeypatch.setattr(trees, "written", noted)
    trees.forest(rows.coalesce(1), 5, 30, 1)
    assert [name for name, _ in tables] == ["tree-rows", "forest"]
    files = tables[0][1].groupBy(F.input_file_name()).count().collect()
    assert len(files) == 10 and max(r["count"] for r in files) < 600
    tables.clear()
    trees.boosted(rows.coalesce(1).withColumn("prediction", F.lit(14.0)), 0, 2, 4, 0.4)
    assert [name for name, _ in tables] == ["tree-rows", "boosting-state", "boosting-state"]


def test_a_large_node_at_full_depth_is_a_leaf(rows, monkeypatch):
    monkeypatch.setattr(trees, "TASK_ROWS", 300)
    predicted, nodes = trees.forest(rows, 2, 1, 1)
    nodes = nodes.collect()
    assert {(n["tree"], n["node"], n["feature"] is None) for n in nodes} == {(t, k, k > 1) for t in range(2) for k in (1, 2, 3)}
    ways = [walked(nodes, rows.where("NOT is_train").collect(), tree) for tree in range(2)]
    assert {r["row"]: r["prediction"] for r in predicted.collect()} == pytest.approx({k: (ways[0][k] + ways[1][k]) / 2 for k in ways[0]})
