"""Toxicity categories by a chain of linear classifiers.

Every link is a sparse logistic regression over the hashed distinct words of the whole text and the log odds of the
categories before it. For training, these odds come from models that have not seen the row (out of fold); for
scoring, from the final earlier links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.words import mixed, numbered_words, slices, string_hashes
from tallyline.sources.scratch import written

FEATURES = 1 << 18
FOLDS = 3
TRAIN_ROWS = 20_000
EPOCHS = 12
BATCH = 32
RATE = 0.3
SPARSITY = 1e-3
START = 1e-2
BUCKETS = 1_000_000


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each text's distinct words (runs of letters and digits, lower-cased), and where texts begin."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN]+", " ")
    codes, distinct, offsets = numbered_words(spaced, lower=False)
    if not len(codes):
        return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    places = (mixed(string_hashes(distinct)) % np.uint64(FEATURES)).astype(np.int64)[codes]
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = np.unique(rows * FEATURES + places)
    return (keys % FEATURES).astype(np.int32), np.searchsorted(keys // FEATURES, np.arange(len(texts) + 1))


def log_odds(
    weights: np.ndarray, features: np.ndarray, bounds: np.ndarray, earlier: np.ndarray
) -> np.ndarray:
    """Scores of rows; ``weights`` ends with those of the earlier categories and the intercept."""
    sums = np.concatenate(([0.0], np.cumsum(weights[features], dtype=np.float64)))
    tail = weights[FEATURES:]
    return sums[bounds[1:]] - sums[bounds[:-1]] + earlier @ tail[:-1] + tail[-1]


def fit_link(features: np.ndarray, bounds: np.ndarray, earlier: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by proximal adaptive steps in a fixed order; most weights end at exactly zero."""
    n, extra = len(y), earlier.shape[1]
    weights = np.zeros(FEATURES + extra + 1)
    squares = np.full(len(weights), START)
    rate_of_ones = (y.sum() + 1) / (n + 2)
    weights[-1] = np.log(rate_of_ones / (1 - rate_of_ones))
    for epoch in range(EPOCHS):
        order = np.random.default_rng(epoch).permutation(n)
        for start in range(0, n, BATCH):
            rows = order[start : start + BATCH]
            sizes = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(sizes)
            at = np.repeat(bounds[rows] - (ends - sizes), sizes) + np.arange(int(ends[-1]))
            own = features[at]
            score = log_odds(weights, own, np.concatenate(([0], ends)), earlier[rows])
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]
            used, inverse = np.unique(own, return_inverse=True)
            gradient = np.bincount(inverse, np.repeat(error, sizes), len(used)) / len(rows)
            squares[used] += gradient**2
            step = RATE / np.sqrt(squares[used])
            moved = weights[used] - step * gradient
            weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * SPARSITY, 0)
            dense = np.append(error @ earlier[rows], error.sum()) / len(rows)
            squares[FEATURES:] += dense**2
            weights[FEATURES:] -= RATE / np.sqrt(squares[FEATURES:]) * dense
    return weights


def _bounded(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the labelled rows at most, chosen by a hash of their ids."""
    share = int(BUCKETS * min(1.0, rows / max(1, labelled.count())))
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)) < share)


def _fold_fit(category: str) -> Callable[[pa.Table], pa.Table]:
    """Fits a link without the rows of fold ``held`` and gives their log odds; without any fold it gives the weights."""

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        held = table.column("held")[0].as_py()
        lists = table.column("features").combine_chunks()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        features = lists.values.to_numpy()
        earlier = np.array(table.column("earlier").to_pylist(), float).reshape(len(table), -1)
        y, folds = table.column(category).to_numpy().astype(float), table.column("fold").to_numpy()
        train = np.flatnonzero(folds != held)
        sizes = np.diff(bounds)[train]
        at = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in train] or [np.empty(0, np.int64)])
        weights = fit_link(features[at], np.concatenate(([0], np.cumsum(sizes))), earlier[train], y[train])
        if held == FOLDS:
            return pa.table({"row": pa.array([None], pa.int64()), "odds": [0.0], "weights": [weights.tobytes()]})
        out = folds == held
        odds = log_odds(weights, features, bounds, earlier)[out]
        return pa.table(
            {
                "row": table.column("row").filter(pa.array(out)),
                "odds": np.clip(odds, -10, 10),
                "weights": pa.nulls(int(out.sum()), pa.binary()),
            }
        )

    return fitted


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], train_rows: int = TRAIN_ROWS) -> list[np.ndarray]:
    """Weights of each link. ``labels`` has doc_id and a 0/1 column a category; rows with a null label are left out.

    At most about ``train_rows`` labelled rows are used; each fold is fitted in a task of its own.
    """
    known = labels.where(" AND ".join(f"{c} IS NOT NULL" for c in ["doc_id", *categories])).dropDuplicates(["doc_id"])
    chosen = F.broadcast(_bounded(known.select("doc_id", *categories), train_rows))
    texts = docs.select("doc_id", "text").join(chosen, "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            features, bounds = text_features(piece.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(features, pa.int32()))
            columns = [piece.column("doc_id"), lists, *(piece.column(c) for c in categories)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "features", *categories])

    schema = "doc_id long, features array<int>, " + ", ".join(f"{c} int" for c in categories)
    rows = texts.select("doc_id", "text", *(F.col(c).cast("int").alias(c) for c in categories))
    rows = written(
        rows.mapInArrow(featured, schema)
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
        .withColumn("earlier", F.array().cast("array<double>")),
        "toxicity-rows",
    )
    chain = []
    for category in categories:
        copies = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(FOLDS))))
        result = written(
            copies.groupBy("held").applyInArrow(_fold_fit(category), "row long, odds double, weights binary"), "toxicity-link"
        )
        final = result.where("weights IS NOT NULL").select("weights").first()
        chain.append(np.frombuffer(final[0]) if final else None)
        odds = result.where("weights IS NULL").select("row", "odds")
        rows = rows.join(odds, "row").withColumn("earlier", F.array_append("earlier", F.col("odds"))).drop("odds")
    return chain


def with_probabilities(docs: DataFrame, chain: list[np.ndarray], categories: list[str]) -> DataFrame:
    """``docs`` and a column ``p_<category>`` for each link; a column of that name is replaced."""
    names = [f"p_{c}" for c in categories]
    rest = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            features, bounds = text_features(piece.column("text"))
            earlier = np.zeros((piece.num_rows, 0))
            for weights in sent.value:
                odds = np.full(piece.num_rows, -10.0)
                if weights is not None:
                    odds = np.clip(log_odds(weights, features, bounds, earlier), -10, 10)
                earlier = np.hstack((earlier, odds[:, None]))
            found = 1 / (1 + np.exp(-earlier))
            columns = [*piece.columns, *(pa.array(found[:, k]) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, *names])

    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return rest.mapInArrow(scored, schema)


def category_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, low_quality, toxic`` from a table of quality and toxic flags."""
    low: Column = 1 - F.col("quality")
    return labels.select("doc_id", low.alias("low_quality"), "toxic")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``p_low_quality``, ``p_toxic`` and ``rejected`` (p_toxic at or above the threshold).

    Null and empty texts have no words and get the odds of a text without any; rows that repeat are scored each;
    without labelled rows nothing is rejected; empty tables give an empty result. Columns of these three names are replaced.
    """
    categories = ["low_quality", "toxic"]
    chain = fit_chain(docs, category_labels(labels), categories)
    return with_probabilities(docs, chain, categories).withColumn("rejected", F.col("p_toxic") >= threshold)
