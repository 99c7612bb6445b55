"""Models on MLlib: linear/forest regression, multinomial logistic regression, forests, MLP,
split-ratio study, batch scoring; ordinal boosting, stacking and the searches have modules of their own.

Training is MLlib's distributed tree/gradient code (treeAggregate); scoring is a
map-only ``transform``. Nothing is collected except model parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import full_partitions, rows_to_score, side_by_side
from .evaluate import classification_metrics
from .ordinal import OrdinalBoost, OrdinalBoostModel  # noqa: F401
from .search import SearchResult, grid_search, random_param_maps, random_search, trials_table  # noqa: F401
from .stacking import Stacking, StackingModel  # noqa: F401

FEATURES = "features"


def assemble(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def linear_regression(df: DataFrame, cols, label: str):
    return LinearRegression(featuresCol=FEATURES, labelCol=label, solver="normal").fit(assemble(df, cols))


def forest_regression(df: DataFrame, cols, label: str, trees: int = 100, seed: int = 42):
    return RandomForestRegressor(featuresCol=FEATURES, labelCol=label, numTrees=trees, seed=seed).fit(
        full_partitions(assemble(df, cols).select(FEATURES, label), "forest-rows"))


def logistic_multinomial(label: str = "label", reg: float = 0.0, features: str = FEATURES):
    """Multinomial logistic regression with an L2 penalty ``reg / 2 * |w|^2`` on the raw weights, beside the mean loss.

    A penalty of ``|w|^2 / 2`` beside the summed loss of n rows is ``reg = 1 / n``."""
    return LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", regParam=reg,
                              elasticNetParam=0.0, standardization=False, maxIter=1000)


def forest_classifier(label: str = "label", trees: int = 100, depth: int = 30, min_leaf: int = 1, seed: int = 42,
                      weight: str | None = None, features: str = FEATURES):
    """Random forest; an unlimited depth becomes 30 (MLlib's maximum). Deep trees keep each row's node, so that a level
    neither ships the forest grown so far to the tasks nor walks every row down it again."""
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=min(depth, 30),
                                minInstancesPerNode=min_leaf, seed=seed, cacheNodeIds=depth > 8)
    if weight:
        rf.setWeightCol(weight)
    return rf


def mlp_classifier(n_features: int, n_classes: int, label: str = "label", hidden=(64, 32), seed: int = 42,
                   features: str = FEATURES):
    return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                          layers=[n_features, *hidden, n_classes], seed=seed, maxIter=200)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Class weights n / (k * n_c) joined on the label (k rows, broadcast if k is small)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    k, tot = counts.agg(F.count(F.lit(1)), F.sum("_nc")).first()
    w = counts.select(label, (F.lit(float(tot)) / (F.lit(float(k)) * F.col("_nc"))).alias(name))
    return df.join(F.broadcast(w) if k <= 10_000 else w, label)


def stacking_fit_predict(train: DataFrame, test: DataFrame, label: str, fold_col: str, id_col: str, bases: dict, n_classes: int):
    """Fit a ``Stacking`` of ``bases`` (name -> Estimator) and score ``test``: (predictions, out-of-fold table)."""
    stack = Stacking(bases, label, fold_col)
    return stack.fit(train).transform(test), stack.out_of_fold


# ---------------------------------------------------------------- scoring (M21) and study

def score(model, df: DataFrame, pred: str = "prediction", prob: str = "probability") -> DataFrame:
    """Batch scoring: class as int plus the probability array."""
    out = model.transform(df)
    cols = [c for c in out.columns if c not in (pred, prob, "rawPrediction")]
    extra = [vector_to_array(prob).alias("probabilities")] if prob in out.columns else []
    return out.select(*cols, F.col(pred).cast("int").alias("pred_class"), *extra)


def split_ratio_study(df: DataFrame, id_col: str, label: str, feature_cols, ratios=(0.1, 0.2, 0.3, 0.4),
                      make_estimator=None, seed: int = 42, groups=None, parallelism: int = 4) -> DataFrame:
    """For each test ratio: stratified split, fit, QWK/accuracy/F1 on the test part -> long table.

    ``groups`` (a ``ColumnGroupTransformer``) is fitted on each ratio's training rows, which keep their own encoding,
    and then encodes its test rows. The ratios are independent and run side by side; each one's
    metrics (six numbers) are computed when its model is fitted, so the result is a small table.
    """
    from ..session import materialize
    from .split import split_flag
    df = materialize(df, "ratios")

    def one(ratio: float) -> list[tuple]:
        d = split_flag(df, id_col, label, ratio, seed)
        train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
        if groups is not None:
            fitted, train = groups.copy().fit_transform(train)
            test = fitted.transform(test)
        est = make_estimator() if make_estimator else forest_classifier(label)
        pred = est.fit(materialize(assemble(train, feature_cols), "ratio-train")).transform(rows_to_score(assemble(test, feature_cols)))
        pred = materialize(pred.select(label, "prediction"), "ratio-scored")      # scored once, for the metrics' filter too
        met = classification_metrics(pred.withColumn("_p", F.col("prediction").cast("int")), label, "_p")
        return [(x["metric"], float(x["value"]), float(ratio)) for x in met.collect()]   # six rows per ratio
    rows = [r for found in side_by_side(one, ratios, parallelism) for r in found]
    return df.sparkSession.createDataFrame(rows, "metric string, value double, test_ratio double")


def pipeline_of(*stages) -> Pipeline:
    return Pipeline(stages=list(stages))
