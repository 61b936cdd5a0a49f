"""Regression trees over tables of any size: forests and boosted rounds.

While a node has more than ``TASK_ROWS`` rows, it is split by histograms: sums a block of rows, a group a node that adds
them and finds the best cut. Rows find their node by following the cuts made so far, which are as few as there are nodes of that
size, so a level of all trees is one scan that writes no rows. A smaller
node goes to one task with its rows, which completes its subtree with exact cuts, all nodes of a level at once. Rows
to be predicted (weight 0) take the same way as the rows that are learned from. Nodes come back as a table.

A node's score is ``S^2 / (W + penalty)`` for the weighted sum ``S`` of its targets and its weight ``W``; its value is
``S / (W + penalty)``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.sources.scratch import written

TASK_ROWS = 1 << 17
#: Rows of a part of the table, and rows that a task sums up at once.
PART_ROWS, BLOCK_ROWS = 1 << 15, 1 << 16
BINS = 256
#: Among the numbers of draws: a row that is only predicted.
HELD_OUT = 255
TREES_AT_ONCE = 20
ROUNDS_AT_ONCE = 25
#: Scores this near to each other count as equal: sums in another order differ by less.
TIE = 1e-11

#: Either a row's ``value`` in a tree, or a node: ``feature`` is null for a leaf, rows with x <= threshold go left.
GROWN = "tree int, row long, value double, node long, feature int, threshold double, gain double"
NAMES = [c.split()[0] for c in GROWN.split(", ")]
#: A node without a row.
NODE = [("tree", "int"), ("value", "double"), ("node", "long"), ("feature", "int"), ("threshold", "double"), ("gain", "double")]
#: The best cut of a large node; the root of a tree is node 1, the children of k are 2k and 2k + 1.
BEST = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("n", pa.int64()), ("value", pa.float64()), ("feature", pa.int32()),
                  ("cut", pa.int32()), ("gain", pa.float64()), ("n_left", pa.int64())])


# --- in one task ----------------------------------------------------------------


def _best_cuts(x, order, starts, seg, weight, moment, w_all, s_all, penalty):
    """Gain and threshold of the best cut of every segment of ``order`` along one feature; gain -1 where there is none."""
    gains, thresholds = np.full(len(starts), -1.0), np.zeros(len(starts))
    at = x[order]
    cut = np.flatnonzero((at[:-1] < at[1:]) & (seg[:-1] == seg[1:]))
    if not len(cut):
        return gains, thresholds
    own, s = seg[cut], np.cumsum(moment[order])
    s_left = s[cut] - np.concatenate(([0.0], s))[starts][own]
    if weight is None:
        w_left = (cut + 1 - starts[own]).astype(float)
    else:
        w = np.cumsum(weight[order])
        w_left = w[cut] - np.concatenate(([0.0], w))[starts][own]
    w_right, s_right = w_all[own] - w_left, s_all[own] - s_left
    score = s_left**2 / (w_left + penalty) + s_right**2 / (w_right + penalty)
    first = np.flatnonzero(np.diff(own, prepend=-1))
    highest = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score >= np.repeat(highest * (1 - TIE), np.diff(np.append(first, len(own)))))
    hit = hit[np.flatnonzero(np.diff(own[hit], prepend=-1))]
    node, low, high = own[hit], at[cut[hit]], at[cut[hit] + 1]
    middle = low + (high - low) / 2
    gains[node] = score[hit] - s_all[node] ** 2 / (w_all[node] + penalty)
    thresholds[node] = np.where(middle < high, middle, low)
    return gains, thresholds


def _partitioned(order, key, sizes):
    """``order``, grouped by parents, regrouped by ``key`` (2 * parent + right), keeping the order within each child."""
    parents = sizes[0::2] + sizes[1::2]
    starts = np.cumsum(parents) - parents
    parent, right = key >> 1, key & 1
    lefts = np.cumsum(1 - right)
    rank = lefts - (1 - right) - np.concatenate(([0], lefts))[starts][parent]
    place = np.where(right == 0, starts[parent] + rank, np.arange(len(order)) - rank + sizes[0::2][parent])
    out = np.empty_like(order)
    out[place] = order
    return out


def grow(x, target, weight, depth, penalty, least_gain):
    """A tree on arrays, level by level: every row's value, and ``node, feature, threshold, gain, value`` of its nodes.

    Cuts lie half-way between neighbouring values. Among equal gains the first feature and the lowest cut win. A node with
    one target value, without a cut or at full depth is a leaf.
    """
    values, at = np.zeros(len(target)), np.zeros(len(target), np.int64)
    x = np.asfortranarray(x)
    learned = np.flatnonzero(weight > 0)
    found = []
    if not len(learned):
        return values, (np.array([1]), np.array([-1]), np.zeros(1), np.zeros(1), np.zeros(1))
    moment = weight * target
    weight = None if (weight[learned] == 1).all() else weight
    orders = [learned[np.argsort(x[learned, j], kind="stable")] for j in range(x.shape[1])]
    sizes, nodes = np.array([len(learned)]), np.ones(1, np.int64)
    for level in range(depth + 1):
        starts = np.cumsum(sizes) - sizes
        seg = np.repeat(np.arange(len(sizes)), sizes)
        # Sums in the order of the rows, whatever the features.
        own = orders[0]
        w_all = sizes.astype(float) if weight is None else np.add.reduceat(weight[own], starts)
        s_all = np.add.reduceat(moment[own], starts)
        value = s_all / (w_all + penalty)
        mixed = np.minimum.reduceat(target[own], starts) < np.maximum.reduceat(target[own], starts)
        gain, feature, threshold = np.full(len(sizes), -1.0), np.zeros(len(sizes), np.int64), np.zeros(len(sizes))
        if level < depth:
            for j, order in enumerate(orders):
                gains, thresholds = _best_cuts(x[:, j], order, starts, seg, weight, moment, w_all, s_all, penalty)
                better = gains > gain + TIE * (np.maximum(gain, 0.0) + s_all**2 / (w_all + penalty))
                gain[better], feature[better], threshold[better] = gains[better], j, thresholds[better]
        split = mixed & (gain > least_gain)
        found.append((nodes, np.where(split, feature, -1), threshold, np.where(split, gain, 0.0), value))
        here = np.flatnonzero(at >= 0)
        ends = here[~split[at[here]]]
        values[ends], at[ends] = value[at[ends]], -1
        if not split.any():
            break
        here = here[at[here] >= 0]
        number = np.cumsum(split) - 1
        right = x[here, feature[at[here]]] > threshold[at[here]]
        at[here] = 2 * number[at[here]] + right
        nodes = np.stack((2 * nodes[split], 2 * nodes[split] + 1), 1).ravel()
        orders = [order[at[order] >= 0] for order in orders]
        sizes = np.bincount(at[orders[0]], minlength=len(nodes))
        orders = [_partitioned(order, at[order], sizes) for order in orders]
    return values, tuple(np.concatenate(column) for column in zip(*found))


def _below(top: int, nodes: np.ndarray) -> np.ndarray:
    """Names of a subtree's nodes in the whole tree, where its root is ``top``."""
    bits = np.int64(1) << (np.frexp(nodes.astype(float))[1] - 1).astype(np.int64)
    return (np.int64(top) - 1) * bits + nodes


def _node_batch(tree: int, top: int, found: tuple) -> pa.RecordBatch:
    nodes, feature, threshold, gain, value = found
    leaf = feature < 0
    columns = [
        pa.array(np.full(len(nodes), tree), pa.int32()), pa.nulls(len(nodes), pa.int64()), pa.array(value),
        pa.array(_below(top, nodes)), pa.array(feature, pa.int32(), mask=leaf), pa.array(threshold, mask=leaf),
        pa.array(gain, mask=leaf),
    ]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _value_batch(tree: int, rows: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    empty = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.float64(), pa.float64())]
    columns = [pa.array(np.full(len(rows), tree), pa.int32()), pa.array(rows), pa.array(values), *empty]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _arrays(table: pa.Table) -> tuple[np.ndarray, ...]:
    """``row, target, weight, x`` of a group, in the order of the rows' numbers."""
    table = table.sort_by("row").combine_chunks()
    flat = pa.chunked_array(table.column("x").chunks, table.column("x").type).combine_chunks().flatten().to_numpy()
    row, target, weight = (table.column(c).to_numpy() for c in ("row", "target", "weight"))
    return row, target.copy(), weight, flat.reshape(len(row), -1)


# --- over the cluster -------------------------------------------------------------


class Top:
    """The part of a tree that is cut by histograms: its nodes, numbered as they come; the root is 0."""

    def __init__(self, rows: int):
        self.names, self.sizes, self.feature, self.cut, self.left = [1], [rows], [-1], [0], [0]
        self.value, self.gain = [None], [None]

    def large(self) -> list[int]:
        """Nodes that are still too large for a task."""
        return [k for k, n in enumerate(self.sizes) if n > TASK_ROWS and self.feature[k] < 0 and self.value[k] is None]

    def small(self) -> int:
        """How many nodes are left to tasks."""
        return sum(f < 0 and v is None for f, v in zip(self.feature, self.value))

    def found(self, node: int, best: dict, depth: int) -> None:
        """Split a node by its best cut, or make it a leaf; it stays as it is where it has no more rows than a task takes."""
        self.sizes[node] = best["n"]
        if best["n"] <= TASK_ROWS:
            return
        name, self.value[node] = self.names[node], best["value"]
        if best["feature"] is None or name.bit_length() > depth:
            return
        self.feature[node], self.cut[node], self.gain[node] = best["feature"], best["cut"], best["gain"]
        self.left[node] = len(self.names)
        self.names += [2 * name, 2 * name + 1]
        self.sizes += [best["n_left"], best["n"] - best["n_left"]]
        for column, fill in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, None), (self.gain, None)):
            column += [fill, fill]

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row has reached."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            live = live[feature[at[live]] >= 0]
            if not len(live):
                return at
            node = at[live]
            at[live] = left[node] + (bins[live, feature[node]] > cut[node])

    def rows(self, tree: int, edges: np.ndarray) -> list[tuple]:
        """``tree, value, node, feature, threshold, gain`` of the nodes that are done."""
        return [
            (tree, v, name, *((f, float(edges[f, c]), g) if f >= 0 else (None, None, None)))
            for name, v, f, c, g in zip(self.names, self.value, self.feature, self.cut, self.gain)
            if v is not None
        ]


def _edges(rows: DataFrame) -> np.ndarray:
    """``BINS - 1`` cuts of every feature by approximate quantiles; repeated ones where a feature has few values."""
    width = rows.select(F.size("x").alias("n")).first()["n"]
    columns = rows.select(*(F.col("x")[j].alias(f"x{j}") for j in range(width)))
    shares = [k / BINS for k in range(1, BINS)]
    return np.array(columns.approxQuantile([f"x{j}" for j in range(width)], shares, 1 / (4 * BINS)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches of a task, put together to at least ``BLOCK_ROWS`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """A column of a block as one array."""
    return pa.concat_arrays(column.chunks)


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    """(row x byte) of a column of equally long byte strings."""
    values = _flat(column)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].reshape(len(values), -1)


def _byte_strings(table: np.ndarray) -> pa.Array:
    offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer(offsets), pa.py_buffer(table.tobytes())])


def dealt(rows: DataFrame, n: int, edges: np.ndarray | None, hashes: list[Column]) -> DataFrame:
    """``rows`` written in parts of like size, with ``draws`` and, where there are edges, ``bins``.

    ``draws`` has a byte a tree: how often the row is drawn, ``HELD_OUT`` for rows that are only predicted. ``hashes`` has a
    long a tree; without them every learned row is drawn once. ``bins`` has a byte a feature.
    """
    columns = [c for c in rows.columns if c not in ("bins", "draws")]
    by_hash = bool(hashes)
    below = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(16)])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = {c: batch.column(c) for c in columns}
            draws = np.ones((batch.num_rows, 1), np.uint8)
            if by_hash:
                share = (batch.column("hashes").flatten().to_numpy() & ((1 << 40) - 1)) / float(1 << 40)
                draws = np.searchsorted(below, share, "right").astype(np.uint8).reshape(batch.num_rows, -1)
            draws[~batch.column("is_train").to_numpy(zero_copy_only=False)] = HELD_OUT
            out["draws"] = _byte_strings(draws)
            if edges is not None:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                bins = [np.searchsorted(edges[j], x[:, j], "left") for j in range(len(edges))]
                out["bins"] = _byte_strings(np.stack(bins, 1).astype(np.uint8))
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    schema += ", draws binary" + ", bins binary" * (edges is not None)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    hashed = rows.select(*columns, *([F.array(*hashes).alias("hashes")] if by_hash else []))
    return written(hashed.repartition(parts, "row").mapInArrow(drawn, schema), "tree-rows")


def _best(sums: np.ndarray, penalty: float, least_gain: float) -> dict:
    """The best cut of a node from its (feature x bin x [rows, weight, moment]) sums."""
    n, w, s = np.moveaxis(np.cumsum(sums, 1), 2, 0)
    all_w, all_s = w[0, -1], s[0, -1]
    whole = all_s**2 / (all_w + penalty) if all_w + penalty else 0.0
    there = (w > 0) & (w < w[:, -1:])
    rest_w, rest_s = np.where(there, w[:, -1:] - w, 1.0), s[:, -1:] - s
    gain = np.where(there, s**2 / (np.where(there, w, 1.0) + penalty) + rest_s**2 / (rest_w + penalty) - whole, -1.0)
    best = {"n": int(n[0, -1]), "value": float(all_s / (all_w + penalty)) if all_w + penalty else 0.0}
    if not gain.max() > least_gain:
        return best | {"feature": None, "cut": None, "gain": None, "n_left": None}
    at = int(np.argmax((gain >= gain.max() - TIE * (gain.max() + whole)) & there))
    feature, cut = divmod(at, gain.shape[1])
    return best | {"feature": feature, "cut": cut, "gain": float(gain[feature, cut]), "n_left": int(n[feature, cut])}


def _level(rows: DataFrame, tops: dict[int, Top], first: int, width: int, penalty: float, least_gain: float) -> DataFrame:
    """``tree, node, n, value, feature, cut, gain, n_left`` of every large node of ``tops``, from one scan of ``rows``."""
    large = {tree: top.large() for tree, top in tops.items()}
    large = {tree: nodes for tree, nodes in large.items() if nodes}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            all_bins, all_draws = _bytes(block.column("bins")), _bytes(block.column("draws"))
            all_targets = block.column("target").to_numpy()
            for tree, nodes in large.items():
                draws = all_draws[:, tree - first]
                here = np.flatnonzero(draws)
                slots = np.full(len(tops[tree].names), -1)
                slots[nodes] = np.arange(len(nodes))
                bins = all_bins[here]
                slot = slots[tops[tree].places(bins)]
                inside = np.flatnonzero(slot >= 0)
                slot, bins, here = slot[inside], bins[inside], here[inside]
                weight = np.where(draws[here] == HELD_OUT, 0, draws[here]).astype(float)
                moment, cells = weight * all_targets[here], len(nodes) * BINS
                sums = np.empty((len(nodes), width, BINS, 3))
                for j in range(width):
                    cell = slot * BINS + bins[:, j]
                    for k, v in enumerate((None, weight, moment)):
                        sums[:, j, :, k] = np.bincount(cell, v, cells).reshape(-1, BINS)
                lists = pa.ListArray.from_arrays(np.arange(len(nodes) + 1, dtype=np.int32) * (width * BINS * 3), sums.ravel())
                columns = [pa.array(np.full(len(nodes), tree), pa.int32()), pa.array(nodes, pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "sums"])

    def best(table: pa.Table) -> pa.Table:
        total = np.zeros(width * BINS * 3)
        for chunk in table.column("sums").chunks:
            total += chunk.flatten().to_numpy().reshape(len(chunk), -1).sum(0)
        row = _best(total.reshape(width, BINS, 3), penalty, least_gain)
        return pa.Table.from_pylist([{"tree": table.column("tree")[0].as_py(), "node": table.column("node")[0].as_py()} | row], BEST)

    partial = rows.select("bins", "draws", "target").mapInArrow(summed, "tree int, node int, sums array<double>")
    return partial.groupBy("tree", "node").applyInArrow(
        best, "tree int, node int, n long, value double, feature int, cut int, gain double, n_left long"
    )


def _tops(rows: DataFrame, trees: range, n: int, depth: int, width: int, penalty: float, least_gain: float) -> dict[int, Top]:
    """Trees cut until no node has more than ``TASK_ROWS`` rows, all at once, a scan a level; ``n``: all rows."""
    tops = {tree: Top(n) for tree in trees}
    while any(top.large() for top in tops.values()):
        # A row a node of more than TASK_ROWS rows.
        for row in _level(rows, tops, trees[0], width, penalty, least_gain).toArrow().to_pylist():
            tops[row["tree"]].found(row["node"], row, depth)
    return tops


def _in_nodes(rows: DataFrame, tops: dict[int, Top], first: int) -> DataFrame:
    """``rows`` without draws, once for each of ``tops`` that has them, with ``tree, node, weight``; ``value`` in leaves.

    Rows of a node that is left to a task come together there.
    """
    kept = [c for c in rows.columns if c != "draws"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            all_draws = _bytes(block.column("draws"))
            all_bins = _bytes(block.column("bins")) if "bins" in kept else np.empty((len(all_draws), 0), np.uint8)
            for tree, top in tops.items():
                draws = all_draws[:, tree - first]
                here = np.flatnonzero(draws)
                at = top.places(all_bins[here])
                value, weight = pa.array(top.value, pa.float64()), np.where(draws[here] == HELD_OUT, 0, draws[here])
                table = block.select(kept)
                table = table if len(here) == len(table) else table.take(pa.array(here))
                for name, column in (
                    ("tree", pa.array(np.full(len(here), tree), pa.int32())),
                    ("node", pa.array(np.array(top.names, np.int64)[at])),
                    ("weight", pa.array(weight.astype(float))),
                    ("value", value.take(pa.array(at))),
                ):
                    table = table.append_column(name, column)
                yield from table.to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    return rows.mapInArrow(placed, schema + ", tree int, node long, weight double, value double")


def _tasks(tops: dict[int, Top], rows: DataFrame) -> int:
    """Into how many parts the nodes go: so many that two nodes of up to ``TASK_ROWS`` rows seldom meet, whatever their bytes."""
    small = sum(top.small() for top in tops.values())
    return max(rows.sparkSession.sparkContext.defaultParallelism, small, min(4 * small, 256))


def _top_nodes(done: list[tuple], rows: DataFrame) -> DataFrame:
    """``done`` nodes, a row a node of more than ``TASK_ROWS`` rows, as a table."""
    return rows.sparkSession.createDataFrame(done, ", ".join(f"{c} {kind}" for c, kind in NODE))


def _ended(tops: dict[int, Top]) -> bool:
    """Whether rows lie in leaves that were found by histograms."""
    return any(f < 0 and v is not None for top in tops.values() for f, v in zip(top.feature, top.value))


def _no_node() -> list[Column]:
    return [F.lit(None).cast(t).alias(c) for c, t in (("node", "long"), ("feature", "int"), ("threshold", "double"), ("gain", "double"))]


def grown_trees(
    rows: DataFrame, tops: dict[int, Top], first: int, edges: np.ndarray | None, depth: int, penalty: float, least_gain: float
) -> DataFrame:
    """``GROWN`` for the trees of ``tops``, with values of the held-out rows; ``first`` is the tree of the first draw.

    A node that is left open is completed in a task; one of more than ``TASK_ROWS`` rows at full depth or without a cut is a leaf.
    """

    def completed(table: pa.Table) -> pa.Table:
        tree, top = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        row, target, weight, x = _arrays(table)
        values, found = grow(x, target, weight, depth - (top.bit_length() - 1), penalty, least_gain)
        out = weight == 0
        return pa.Table.from_batches([_node_batch(tree, top, found), _value_batch(tree, row[out], values[out])])

    placed = _in_nodes(rows.drop("key", "is_train"), tops, first)
    open_rows = placed.where("value IS NULL").select("tree", "node", "row", "target", "weight", "x")
    parts = [open_rows.repartition(_tasks(tops, rows), "tree", "node").groupBy("tree", "node").applyInArrow(completed, GROWN)]
    if _ended(tops):
        parts.append(placed.where("value IS NOT NULL AND weight = 0").select("tree", "row", "value", *_no_node()))
    if done := [row for tree, top in tops.items() for row in top.rows(tree, edges)]:
        parts.append(_top_nodes(done, rows).withColumn("row", F.lit(None).cast("long")))
    return reduce(DataFrame.unionByName, parts)


def forest(rows: DataFrame, trees: int, depth: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Bagged trees over ``rows(row, key, is_train, target, x)``: ``row, prediction`` of the held-out rows, and all nodes.

    How often a row is drawn for a tree is Poisson with mean 1, by a hash of the row's key. Trees come in batches of
    ``TREES_AT_ONCE``, which bounds what is on disk; each batch's results are written.
    """
    n, made = rows.count(), []
    edges = _edges(rows) if n > TASK_ROWS else None
    hashes = [F.xxhash64(F.col("key"), F.lit(tree), F.lit(seed)) for tree in range(trees)]
    rows = dealt(rows.select("row", "key", "is_train", "target", "x"), n, edges, hashes)
    for first in range(0, trees, TREES_AT_ONCE):
        batch = range(first, min(trees, first + TREES_AT_ONCE))
        tops = {tree: Top(n) for tree in batch}
        drawn = rows.withColumn("draws", F.substring("draws", first + 1, len(batch)))
        if edges is not None:
            tops = _tops(drawn, batch, n, depth, len(edges), 0.0, 0.0)
        made.append(written(grown_trees(drawn, tops, first, edges, depth, 0.0, 0.0), "forest"))
    grown = reduce(DataFrame.unionByName, made)
    predicted = grown.where("row IS NOT NULL").groupBy("row").agg(F.avg("value").alias("prediction"))
    return predicted, grown.where("row IS NULL").drop("row")


def boosted(
    state: DataFrame, first: int, rounds: int, depth: int, rate: float, penalty: float = 1.0, least_gain: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """``rounds`` more trees on ``state(row, is_train, target, prediction, x)``: the new state, and the new nodes.

    Every tree is fitted to what is left of the targets; its values times ``rate`` join the predictions. Rounds are numbered
    from ``first``. After each block the state is a written table, so a fit may stop there and be taken up again with it;
    the result is the same. Where all rows fit a task, a block of rounds stays in it; else a block is one round.
    """
    n = state.count()
    if n > TASK_ROWS:
        return _boosted_apart(state, n, range(first, first + rounds), depth, rate, penalty, least_gain)
    nodes = []

    def whole_rounds(start: int, stop: int):
        def run(table: pa.Table) -> pa.Table:
            row, target, weight, x = _arrays(table)
            prediction, out = table.sort_by("row").column("prediction").to_numpy().copy(), []
            for tree in range(start, stop):
                values, found = grow(x, target - prediction, weight, depth, penalty, least_gain)
                prediction += rate * values
                out.append(_node_batch(tree, 1, found))
            return pa.Table.from_batches([*out, _value_batch(stop, row, prediction)])

        return run

    for start in range(first, first + rounds, ROUNDS_AT_ONCE):
        stop = min(first + rounds, start + ROUNDS_AT_ONCE)
        weighted = state.withColumn("weight", F.col("is_train").cast("double"))
        rows = weighted.select("row", "target", "weight", "x", "prediction")
        grown = written(rows.groupBy().applyInArrow(whole_rounds(start, stop), GROWN), "boosted")
        nodes.append(grown.where("row IS NULL").drop("row"))
        values = grown.where("row IS NOT NULL").select("row", "value")
        state = written(state.join(values, "row").withColumn("prediction", F.col("value")).drop("value"), "boosting-state")
    return state, reduce(DataFrame.unionByName, nodes)


def _boosted_apart(
    state: DataFrame, n: int, rounds: range, depth: int, rate: float, penalty: float, least_gain: float
) -> tuple[DataFrame, DataFrame]:
    """``boosted`` for more rows than a task takes: rows go to their nodes' tasks and come back as the next state."""
    edges, done, nodes = _edges(state), [], []
    kept = [c for c in state.columns if c not in ("tree", "node", "weight", "value")]
    state = dealt(state.select(*kept), n, edges, [])
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(f"{c} {kind}" for c, kind in (*kinds.items(), *NODE))

    def completed(table: pa.Table) -> pa.Table:
        tree, top = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        table = table.sort_by("row")
        _, target, weight, x = _arrays(table)
        prediction = table.column("prediction").to_numpy()
        values, found = grow(x, target - prediction, weight, depth - (top.bit_length() - 1), penalty, least_gain)
        moved = table.select(list(kinds))
        moved = moved.set_column(moved.column_names.index("prediction"), "prediction", pa.array(prediction + rate * values))
        made = pa.Table.from_batches([_node_batch(tree, top, found)]).drop_columns(["row"])
        both = pa.concat_tables([moved, made], promote_options="default")
        return both.select([*kinds, *dict(NODE)])

    for tree in rounds:
        left = state.withColumn("target", F.col("target") - F.col("prediction"))
        tops = _tops(left, range(tree, tree + 1), n, depth, len(edges), penalty, least_gain)
        with_draws = state.withColumn("_draws", F.col("draws"))
        placed = _in_nodes(with_draws, tops, tree).withColumnRenamed("_draws", "draws")
        tasks = placed.where("value IS NULL").drop("value").repartition(_tasks(tops, state), "tree", "node")
        grown = tasks.groupBy("tree", "node").applyInArrow(completed, schema)
        if _ended(tops):
            now = F.col("prediction") + rate * F.col("value")
            there = placed.where("value IS NOT NULL").withColumn("prediction", now)
            grown = grown.unionByName(there.select(*kinds, "tree", F.lit(None).cast("double").alias("value"), *_no_node()))
        grown = written(grown, "boosting-state")
        nodes.append(grown.where("row IS NULL").select(*dict(NODE)))
        done += tops[tree].rows(tree, edges)
        state = grown.where("row IS NOT NULL").select(*kinds)
    return state.select(*kept), reduce(DataFrame.unionByName, [*nodes, _top_nodes(done, state)] if done else nodes)


def mean_gain(nodes: DataFrame) -> DataFrame:
    """``feature, importance``: mean gain of a feature's cuts, as a share of all features' means."""
    means = nodes.where("feature IS NOT NULL").groupBy("feature").agg(F.avg("gain").alias("gain"))
    return _shares(means)


def gain_by_tree(nodes: DataFrame) -> DataFrame:
    """``feature, importance``: a feature's share of each tree's gains, averaged over the trees."""
    gains = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    share = F.col("gain") / F.sum("gain").over(Window.partitionBy("tree"))
    return _shares(gains.withColumn("gain", share).groupBy("feature").agg(F.sum("gain").alias("gain")))


def _shares(gains: DataFrame) -> DataFrame:
    # A row a feature, so the window is as small as the list of features.
    return gains.select("feature", (F.col("gain") / F.sum("gain").over(Window.partitionBy(F.lit(1)))).alias("importance"))
