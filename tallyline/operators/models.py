"""Encodings, clusters and regression models on Spark ML.

Nothing here depends on the number of distinct category values fitting on the
driver: the line models keep a table of effects a category (``ridge``), ``fit_regressor`` hashes categories into slots,
many times as many as there are levels, trees use one mean-encoded number per category column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions.columns import clipped, exact_sum, fold_of, in_train_split, ratio
from tallyline.operators.clusters import UNIT, assign_clusters, fit_clusters
from tallyline.operators.customers import CUSTOMER_FEATURES, customer_features, segment_features
from tallyline.operators.freight import region_freight
from tallyline.operators.grouping import attach, exact_quantiles, with_positions, with_row
from tallyline.operators.products import MONEY
from tallyline.operators.profile import grouped, long_form
from tallyline.operators.ridge import Ridges, Target, fit_ridges
from tallyline.operators.statistics import regression_metrics
from tallyline.operators.trees import boosted, forest, gain_by_tree, mean_gain
from tallyline.sources.scratch import in_slices, written
from tallyline.schema import CATEGORY_COLUMNS, LINE_KEY, MEASURES, fill_missing_columns, require_columns

SEED = 42
LINE_CATEGORIES = (*CATEGORY_COLUMNS, "item_number", "order_channel", "order_region", "customer_agreement")


# --- splits and encodings ---------------------------------------------------


def train_test_split(df: DataFrame, key: str = LINE_KEY, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows, chosen by a hash of the row key."""
    flag = in_train_split(key, train_percent)
    return df.filter(flag), df.filter(~flag)


def split_flags(df: DataFrame, key: str = LINE_KEY) -> DataFrame:
    return df.select(key, in_train_split(key).cast("int").alias("is_train"))


def code_table(df: DataFrame, columns: Sequence[str], split_rows: int | None = None) -> DataFrame:
    """Code of every value of every column, in sorted order from 0."""
    # Written, as the look for hot columns and the codes both read them.
    found = written(long_form(df, columns, "dimension", "value").distinct(), "values")
    values = found.withColumn("_n", F.lit(1).cast("bigint"))
    placed = with_positions(values, ["dimension"], "value", "_n", split_rows)
    return placed.select("dimension", "value", F.col("_first").cast("int").alias("code"))


def category_codes(df: DataFrame, columns: Sequence[str], split_rows: int | None = None) -> DataFrame:
    """Add ``<column>_code``; missing values get -1. The columns themselves are kept."""
    codes = written(code_table(df, columns, split_rows), "codes")
    # A row a column. The column with most values comes last: where it takes a shuffle, the rows carry codes instead of texts.
    values = {r["dimension"]: r["count"] for r in codes.groupBy("dimension").count().collect()}
    coded, shown = df, list(df.columns)
    for c in sorted(columns, key=lambda c: values.get(c, 0)):
        own = codes.filter(F.col("dimension") == c).select(
            F.col("value").alias(c), F.col("code").alias(f"{c}_code")
        )
        coded = attach(coded, own, [c]).withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    for c in columns:
        shown = [c, *(s for s in shown if s != c), f"{c}_code"]
    return coded.select(*shown)


ENCODED = ("customer_agreement", *CATEGORY_COLUMNS)


def target_encode(
    df: DataFrame,
    columns: Sequence[str] = ENCODED,
    target: str = "delivered_margin",
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_encoded``: the mean target of the row's category value.

    By default the means include the row itself; pass the train rows as
    ``fit_on`` to keep holdout targets out. Values unseen there get the mean of
    ``fit_on``.
    """
    source = df if fit_on is None else fit_on
    overall = source.agg(F.avg(target).alias("mean"))
    # All means from one scan: a scan a column would hold as many broadcasts of its joins at once on the driver.
    named = source.select(F.col(target).alias("_target"), *(F.col(c).cast("string").alias(c) for c in columns))
    sums = long_form(named, columns, "dimension", "value", ["_target"]).groupBy("dimension", "value")
    means = written(sums.agg(F.avg("_target").alias("mean")), "encodings")
    for c in columns:
        own = means.filter(F.col("dimension") == c)
        df = attach(df, own.select(F.col("value").cast(df.schema[c].dataType).alias(c), F.col("mean").alias(f"{c}_encoded")), [c])
    if fit_on is None:
        return df
    filled = with_row(df, overall, "_overall")
    return filled.withColumns(
        {f"{c}_encoded": F.coalesce(f"{c}_encoded", "_overall.mean") for c in columns}
    ).drop("_overall")


SLOTS_A_LEVEL, LEAST_SLOTS = 32, 1 << 14


def slot_counts(ready: DataFrame, categorical: Sequence[str]) -> list[int]:
    """Per column a power of two, at least ``SLOTS_A_LEVEL`` times its (estimated) number of levels.

    So about one level in 32 at most shares its slot, however many levels there are.
    """
    if not categorical:
        return []
    levels = ready.agg(*(F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(categorical))).first()
    return [max(LEAST_SLOTS, 1 << (SLOTS_A_LEVEL * max(1, n) - 1).bit_length()) for n in levels]


def feature_stages(numeric: Sequence[str], categorical: Sequence[str], slots: Sequence[int]) -> list:
    """Median imputation and standardising of numbers, hashed one-hot of categories.

    Hashing needs no fitted vocabulary: unseen values are never an error and the
    vector has its number of ``slots`` places for each category column. Missing
    categories are one more value (see ``prepare``).
    """
    filled = [f"{c}_filled" for c in numeric]
    return [
        Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        *(FeatureHasher(inputCols=[c], outputCol=f"{c}_hashed", numFeatures=n) for c, n in zip(categorical, slots)),
        VectorAssembler(inputCols=["_scaled", *(f"{c}_hashed" for c in categorical)], outputCol="features"),
    ]


def prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Inputs in the form ``feature_stages`` expects; absent numbers count as 0."""
    ready = fill_missing_columns(require_columns(df, categorical), numeric)
    return ready.withColumns({c: F.col(c).cast("double") for c in numeric}).fillna(
        "missing", subset=list(categorical)
    )


def preprocessing(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], slots: int | None = None
) -> PipelineModel:
    """With ``slots`` every category column has so many; by default as many as its levels need."""
    ready = prepare(df, numeric, categorical)
    return Pipeline(stages=feature_stages(numeric, categorical, _slots(ready, categorical, slots))).fit(ready)


def _slots(ready: DataFrame, categorical: Sequence[str], slots: int | None) -> list[int]:
    return slot_counts(ready, categorical) if slots is None else [slots] * len(categorical)


# --- saving -------------------------------------------------------------------


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_map(mapping: DataFrame, path: str) -> None:
    """A per-key table such as customer segments."""
    mapping.write.mode("overwrite").parquet(path)


def load_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def fit_once(estimator: Estimator, df: DataFrame):
    """Fit on rows kept for the passes of the fit, on disk where memory is short."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(df)
    finally:
        df.unpersist()


# --- clusters -----------------------------------------------------------------


def customer_clusters(ol: DataFrame, k: int = 5) -> DataFrame:
    return assign_clusters(customer_features(ol), CUSTOMER_FEATURES, k)


def cluster_feature_importance(ol: DataFrame, k: int = 5) -> DataFrame:
    """Absolute mean of the standardised cluster centres per feature."""
    centres, _ = fit_clusters(customer_features(ol), CUSTOMER_FEATURES, k)
    means = [sum(c) / len(c) / UNIT for c in zip(*centres.values())]
    rows = [(f, abs(m)) for f, m in zip(CUSTOMER_FEATURES, means)]
    return ol.sparkSession.createDataFrame(rows, "feature string, importance double")


REGION_FEATURES = ("avg_line_volume_cbm", "avg_freight_cost_per_cbm")


def region_clusters(ol: DataFrame, k: int = 3) -> DataFrame:
    return assign_clusters(region_freight(ol), REGION_FEATURES, k)


PROFIT_FEATURES = ("line_quantity", *MONEY, "total_profit", "avg_profit_margin")


def profitability_factors(ol: DataFrame) -> DataFrame:
    """Sums per item and the mean of the lines' profit margins."""
    margin = ratio("total_profit", "line_product_revenue") * 100.0
    return grouped(ol, "item_number").agg(
        *(exact_sum(c).alias(c) for c in ("line_quantity", *MONEY, "total_profit")),
        F.avg(margin).alias("avg_profit_margin"),
    )


def profitability_clusters(ol: DataFrame, k: int = 3) -> DataFrame:
    return assign_clusters(profitability_factors(ol), PROFIT_FEATURES, k)


SEGMENT_FEATURES = ("total_revenue", "line_quantity", "avg_delivered_margin", "avg_predicted_margin")


def customer_segments(predicted: DataFrame, prediction: str, k: int = 3) -> DataFrame:
    """Segment and mean predicted margin of each customer."""
    table = segment_features(predicted, prediction)
    return assign_clusters(table, SEGMENT_FEATURES, k).withColumnRenamed(
        "cluster", "customer_segment"
    )


def with_segments(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Bring segment and mean predicted margin back onto the order lines."""
    maps = segments.select("customer_name", "customer_segment", "avg_predicted_margin")
    return attach(lines, maps, ["customer_name"])


def cluster_profile(clustered: DataFrame, features: Sequence[str], median_of: str | None = None) -> DataFrame:
    """Half-even rounded feature means, size and share per cluster, optionally a median.

    One row per cluster, so the share's total is a window over ``k`` rows.
    """
    profile = clustered.groupBy("cluster").agg(
        *(F.bround(F.avg(f), 2).alias(f"avg_{f}") for f in features), F.count(F.lit(1)).alias("members")
    )
    share = F.col("members") / F.sum("members").over(Window.partitionBy(F.lit(1)))
    profile = profile.withColumn("percentage", F.bround(share * 100.0, 2))
    if median_of is None:
        return profile
    medians = exact_quantiles(clustered, median_of, [0.5], ["cluster"])
    return profile.join(
        medians.select("cluster", F.col("quantiles")[0].alias(f"median_{median_of}")), "cluster"
    )


def best_and_worst_cluster(profile: DataFrame, metric: str) -> DataFrame:
    return profile.agg(
        F.max_by("cluster", metric).alias("high_value_cluster"),
        F.min_by("cluster", metric).alias("low_value_cluster"),
    )


def cluster_describe(clustered: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows, mean, sample deviation, least, exact quartiles and largest value of each feature in each cluster."""
    long = long_form(clustered, features, "metric", "value", ["cluster"])
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["cluster", "metric"])
    sums = long.groupBy("cluster", "metric").agg(
        F.count("value").alias("rows"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").cast("double").alias("least"),
        F.max("value").cast("double").alias("most"),
    )
    shown = [F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))]
    return sums.join(quartiles, ["cluster", "metric"]).select(*sums.columns, *shown)


def cluster_outliers(clustered: DataFrame, key: str, features: Sequence[str], limit: float = 3.0) -> DataFrame:
    """Values more than ``limit`` population deviations from their cluster's mean, else NULL.

    The moments are one row per cluster (``k`` rows), joined back by broadcast,
    so a cluster with most of the rows is never gathered in one place.
    """
    moments = clustered.groupBy("cluster").agg(
        *(F.avg(f).alias(f"_mean_{f}") for f in features),
        *(F.stddev_pop(f).alias(f"_std_{f}") for f in features),
    )
    marked = clustered.join(F.broadcast(moments), "cluster").select(
        key,
        "cluster",
        *(
            F.when(F.abs(F.try_divide(F.col(f) - F.col(f"_mean_{f}"), F.col(f"_std_{f}"))) > limit, F.col(f)).alias(f)
            for f in features
        ),
    )
    return marked.dropna("all", subset=list(features))


# --- regressions --------------------------------------------------------------


def _importance_rows(spark: SparkSession, features: Sequence[str], values: Sequence[float]) -> DataFrame:
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _fit_and_score(
    train: DataFrame, test: DataFrame, stages: list, label: str
) -> tuple[PipelineModel, DataFrame]:
    model = fit_once(Pipeline(stages=stages), train)
    return model, regression_metrics(model.transform(test).select(label, "prediction"), label, "prediction")


def margin_linear_model(ol: DataFrame) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Delivered margin from the six measures: model, coefficients, holdout scores."""
    train, test = train_test_split(ol.select(LINE_KEY, "delivered_margin", *MEASURES))
    stages = [
        VectorAssembler(inputCols=list(MEASURES), outputCol="features"),
        LinearRegression(labelCol="delivered_margin", featuresCol="features"),
    ]
    model, scores = _fit_and_score(train, test, stages, "delivered_margin")
    rows = [(f, float(c)) for f, c in zip(MEASURES, model.stages[-1].coefficients)]
    rows.append(("intercept", float(model.stages[-1].intercept)))
    return model, ol.sparkSession.createDataFrame(rows, "feature string, coefficient double"), scores


FOREST_NUMBERS = ("line_volume_cbm", "line_quantity", "line_product_cost", "line_freight_cost")
FOREST_CATEGORIES = ("order_channel", "order_region", "category_1")


def _tree_rows(df: DataFrame, target: str, features: Sequence[str], split: Column) -> DataFrame:
    """The table that trees are grown from, written: numbered rows with their features in one array."""
    x = F.array(*(F.col(c).cast("double") for c in features))
    rows = df.select(F.xxhash64(LINE_KEY).alias("key"), split.alias("is_train"), F.col(target).alias("target"), x.alias("x"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "tree-input")


def _named(importance: DataFrame, features: Sequence[str]) -> DataFrame:
    """Importance of every feature by name, 0 for those never used, highest first."""
    names = importance.sparkSession.createDataFrame(list(enumerate(features)), "number int, feature string")
    found = importance.withColumnRenamed("feature", "number")
    named = names.join(found, "number", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return named.orderBy(F.desc("importance"), "feature")


def _holdout_scores(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    joined = rows.where("NOT is_train").select("row", "target").join(predicted, "row")
    return regression_metrics(joined, "target", "prediction")


def revenue_forest(ol: DataFrame, trees: int = 100, depth: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Total revenue from costs and category codes by bagged trees: the trees' nodes, importances, holdout scores.

    Trees are cut until a leaf has one target value, or at ``depth``. A feature's importance is its share of each tree's gains.
    """
    features = [*FOREST_NUMBERS, *(f"{c}_code" for c in FOREST_CATEGORIES)]
    coded = category_codes(ol.select(LINE_KEY, "total_revenue", *FOREST_NUMBERS, *FOREST_CATEGORIES), FOREST_CATEGORIES)
    rows = _tree_rows(coded, "total_revenue", features, in_train_split(LINE_KEY))
    predicted, nodes = forest(rows, trees, depth, SEED)
    return nodes, _named(gain_by_tree(nodes), features), _holdout_scores(rows, predicted)


def margin_boosted_trees(
    ol: DataFrame, rounds: int = 200, depth: int = 20, leak_free: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delivered margin by boosted trees over encoded categories and the measures: nodes, importances, holdout scores.

    The first prediction is the mean of the train rows; the learning rate is 0.05. A feature's importance is the
    mean gain of its cuts. With ``leak_free`` the encodings come from train rows only.
    """
    ol = ol.select(LINE_KEY, "delivered_margin", *ENCODED, *MEASURES)
    is_train = in_train_split(LINE_KEY)
    encoded = target_encode(ol, fit_on=ol.where(is_train)) if leak_free else target_encode(ol)
    features = [*(f"{c}_encoded" for c in ENCODED), *MEASURES]
    rows = _tree_rows(encoded, "delivered_margin", features, is_train)
    mean = rows.where("is_train").agg(F.avg("target").alias("prediction"))
    state, nodes = boosted(with_row(rows, mean, "_mean").withColumn("prediction", F.coalesce("_mean.prediction", F.lit(0.0))).drop("_mean"),
                           0, rounds, depth, 0.05)
    predicted = state.where("NOT is_train").select("row", "prediction")
    return nodes, _named(mean_gain(nodes), features), _holdout_scores(rows, predicted)


def fit_regressor(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    slots: int | None = None,
    penalty: float = 0.001,
) -> PipelineModel:
    """Ridge regression of ``label`` on standardised numbers and hashed categories."""
    ready = prepare(df.filter(F.col(label).isNotNull()), numeric, categorical)
    stages = [
        *feature_stages(numeric, categorical, _slots(ready, categorical, slots)),
        LinearRegression(labelCol=label, featuresCol="features", solver="l-bfgs", regParam=penalty, maxIter=50),
    ]
    return fit_once(Pipeline(stages=stages), ready.select(label, *numeric, *categorical))


def predict(
    model: PipelineModel, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], name: str
) -> DataFrame:
    """``df`` with the model's output as column ``name``."""
    scored = model.transform(prepare(df, numeric, categorical)).withColumnRenamed("prediction", name)
    return scored.select(*df.columns, name)


ORDER_NUMBERS = ("line_volume_cbm", "line_quantity", "line_product_cost")
# By model: the label as a column, and the numbers it is told from.
LINE_MODELS = {
    "line_freight_cost": ORDER_NUMBERS,
    "delivered_margin": (*ORDER_NUMBERS, "line_freight_revenue"),
    "total_profit": MEASURES,
    "line_quantity": tuple(m for m in MEASURES if m != "line_quantity"),
}


def model_label(name: str) -> Column:
    """What a line model learns: margins from -1 to 1, unknown ones 0; other labels as they are."""
    if name == "delivered_margin":
        return F.coalesce(clipped(name, -1.0, 1.0), F.lit(0.0))
    return F.col(name).cast("double")


def line_models(ol: DataFrame, names: Sequence[str] = tuple(LINE_MODELS), learn: Column | None = None) -> Ridges:
    """Freight cost before shipping, delivered margin, profit and quantity of a line, by the same scans."""
    targets = [Target(n, n if n in MEASURES else model_label(n), LINE_MODELS[n], learn) for n in names]
    return fit_ridges(ol, targets, LINE_CATEGORIES, dealt_by="item_number")


def line_model_scores(ol: DataFrame, names: Sequence[str] = tuple(LINE_MODELS)) -> DataFrame:
    """Scores of the line models on lines held out."""
    is_train = in_train_split(LINE_KEY)
    model = line_models(ol, names, is_train)
    labelled = ol.where(~is_train).withColumns({f"_label_{n}": model_label(n) for n in names})
    scored = model.predict(labelled, {n: f"_predicted_{n}" for n in names})
    both = F.explode(
        F.array(*(F.struct(F.lit(n).alias("label"), F.col(f"_label_{n}").alias("y"), F.col(f"_predicted_{n}").alias("p")) for n in names))
    )
    e = F.col("y") - F.col("p")
    return scored.select(both.alias("_s")).select("_s.*").groupBy("label").agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1.0 - ratio(F.avg(e * e), F.var_pop("y"))).alias("r2")
    )


CV_CATEGORIES = (*CATEGORY_COLUMNS, "item_number", "order_channel", "order_region")


def margin_regressor_cv(
    ol: DataFrame, folds: int = 5, categorical: Sequence[str] = CV_CATEGORIES
) -> tuple[Ridges, DataFrame, DataFrame]:
    """Cross-validated regression of delivered margin: model, importances, scores.

    Folds come from a hash of the line key; all are fitted by the scans that fit the whole. Scores hold the mean and
    deviation of R squared over the folds and the holdout's MSE, MAE and R squared.
    """
    label = "delivered_margin"
    is_train, fold = in_train_split(LINE_KEY), fold_of(LINE_KEY, folds)
    y = F.col(label)
    whole = Target("whole", y, MEASURES, is_train)
    targets = [whole, *(Target(f"fold{f}", y, MEASURES, is_train & (fold != f)) for f in range(folds))]
    model = fit_ridges(ol, targets, categorical, dealt_by="item_number" if "item_number" in categorical else None)
    needed = dict.fromkeys([label, *MEASURES, *categorical])
    rows = ol.select(*needed, F.when(is_train, fold).alias("_fold"))
    own = F.col("_whole")
    for f in range(folds):
        own = F.when(F.col("_fold") == f, F.col(f"_fold{f}")).otherwise(own)

    def errors(part: DataFrame) -> DataFrame:
        scored = model.predict(part, {t.name: f"_{t.name}" for t in targets})
        return scored.select("_fold", label, (F.col(label) - own).alias("_error"))

    scored, e = in_slices(rows, categorical[0] if "item_number" not in categorical else "item_number", errors, "cv-errors"), F.col("_error")
    # A row a fold; the holdout has none.
    by_fold = scored.groupBy("_fold").agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1.0 - ratio(F.avg(e * e), F.var_pop(label))).alias("r2")
    )
    held, inside = F.col("_fold").isNull(), F.col("_fold").isNotNull()
    scores = by_fold.agg(
        F.avg(F.when(inside, F.col("r2"))).alias("cv_r2_mean"),
        F.stddev_pop(F.when(inside, F.col("r2"))).alias("cv_r2_std"),
        *(F.max(F.when(held, F.col(c))).alias(c) for c in ("mse", "mae", "r2")),
    )
    return model, _importance_rows(ol.sparkSession, *zip(*model.importance("whole"))), scores
