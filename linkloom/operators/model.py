"""Splits, folds, grids, boosted trees, and what they are measured by."""

from __future__ import annotations

import itertools
import random
import warnings
from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.scratch import written

# The grid, the split and the seeds.
GRID = {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "alpha": [0, 0.1]}
TEST_SHARE, SPLIT_SEED, FOLD_SEED = 0.3, 42, 1


def draw(key, salt: str):
    """A number in [0, 1) from a key's md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def split(df: DataFrame, key: str, test: float = TEST_SHARE, seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """``(train, test)`` by a hash of the key: unstratified, repeatable, without a shuffle."""
    is_test = draw(F.col(key), f"split{seed}:") < test
    return df.where(~is_test), df.where(is_test)


def folds(df: DataFrame, key: str, label: str | None, n: int, seed: int = FOLD_SEED, repeat: int = 0) -> DataFrame:
    """Adds ``fold`` in [0, n): within each label (or over all without one) rows are dealt in order of a hash.

    Rows are numbered by ranges of (label, hash), so a label fills many tasks; a
    count for each range and label says how many come before. The result is read
    from a written table.
    """
    own = F.col(label) if label else F.lit(0)
    ranged = df.withColumn("_label", own).withColumn("_hash", F.md5(F.concat(F.lit(f"fold{seed}.{repeat}:"), F.col(key).cast("string"))))
    ranged = written(ranged.repartitionByRange("_label", "_hash", key).withColumn("_part", F.spark_partition_id()), "folds")
    before = Window.partitionBy("_label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part", "_label").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.col("_part").alias("_p"), F.col("_label").alias("_l"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part", "_label").orderBy("_hash", key)) - 1)
    dealt = numbered.join(F.broadcast(counts), (F.col("_part") == F.col("_p")) & F.col("_label").eqNullSafe(F.col("_l")))
    return dealt.select(*df.columns, ((F.col("_row") + F.col("_before")) % n).cast("int").alias("fold"))


def param_grid(space: dict[str, list]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def param_rows(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """The grid as a table of doubles."""
    df = spark.range(1)
    for name, values in space.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(float(v)) for v in values))))
    return df.drop("id")


def class_ratio(df: DataFrame, label: str = "link") -> DataFrame:
    """One row, ``ratio``: negatives for each positive, null without positives."""
    return df.agg((F.sum(F.expr(f"cast({label} = 0 as double)")) / F.expr(f"nullif(sum(cast({label} = 1 as double)), 0)")).alias("ratio"))


def gbt(params: dict, features: str = "features", label: str = "link", weight: str | None = None, seed: int = SPLIT_SEED) -> GBTClassifier:
    """Boosted trees with logistic loss; an L1 penalty has no counterpart and is left out."""
    if params.get("alpha"):
        warnings.warn("boosted trees here have no L1 penalty; alpha is ignored", stacklevel=2)
    model = GBTClassifier(featuresCol=features, labelCol=label, maxIter=int(params.get("n_estimators", 20)), maxDepth=int(params.get("max_depth", 5)), seed=seed)
    return model.setWeightCol(weight) if weight else model


def gbt_regressor(params: dict, features: str = "features", label: str = "link", weight: str | None = None, seed: int = SPLIT_SEED) -> GBTRegressor:
    """Boosted trees with squared loss, for a target that isn't a class."""
    model = GBTRegressor(featuresCol=features, labelCol=label, maxIter=int(params.get("n_estimators", 20)), maxDepth=int(params.get("max_depth", 5)), seed=seed)
    return model.setWeightCol(weight) if weight else model


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep").transform(df)


def scored(model: Model, df: DataFrame) -> DataFrame:
    """Adds ``link_probability`` and ``predicted``."""
    out = model.transform(df)
    return out.withColumn("link_probability", vector_to_array("probability")[1]).withColumn("predicted", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "prediction", "features")


def auc(df: DataFrame) -> float:
    return BinaryClassificationEvaluator(labelCol="link", rawPredictionCol="rawPrediction").evaluate(df)


def neg_mean_squared_error(df: DataFrame, label: str = "link") -> float:
    return -RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="mse").evaluate(df)


def tune(
    df: DataFrame,
    columns: list[str],
    space: dict[str, list],
    scoring: dict[str, Callable[[DataFrame], float]] | None = None,
    estimator: Callable[[dict], object] | None = None,
    key: str = "k",
    label: str = "link",
    search_type: str = "grid",
    n_iter_random: int = 100,
    n_splits: int = 5,
    n_repeats: int = 3,
    random_state: int = FOLD_SEED,
    refit: str | None = None,
    modeltype: str = "clf",
) -> tuple[dict, Model, DataFrame]:
    """``(best parameters, model refitted on all rows, scores)`` by repeated k-fold cross-validation.

    Folds are stratified for a classifier (``modeltype`` ``clf``, scored by the
    area under the curve), not for a regressor (``reg``, scored by the negative
    mean squared error), and written once for each repeat. ``search_type`` is
    ``grid`` or ``random`` (a seeded sample of the grid). ``scoring`` maps names to functions
    of transformed rows; the best mean of ``refit`` wins, ties by grid order.
    ``scores`` has ``params, repeat, fold, metric, score``; the best parameters
    get ``threshold``, where true and false positive rates of the refitted model
    are furthest apart on all rows.
    """
    if modeltype not in ("clf", "reg"):
        raise ValueError(f"no such kind of model: {modeltype}")
    scoring = scoring or ({"roc_auc": auc} if modeltype == "clf" else {"neg_mean_squared_error": lambda out: neg_mean_squared_error(out, label)})
    refit = refit or next(iter(scoring))
    grid = param_grid(space)
    if search_type == "random":
        grid = random.Random(random_state).sample(grid, min(n_iter_random, len(grid)))
    elif search_type != "grid":
        raise ValueError(f"no such search: {search_type}")
    build = estimator or (lambda p: (gbt if modeltype == "clf" else gbt_regressor)(p, label=label))
    ready = assembled(df, columns)
    repeats = [folds(ready, key, label if modeltype == "clf" else None, n_splits, random_state, repeat) for repeat in range(n_repeats)]
    rows, means = [], []
    for n, params in enumerate(grid):
        total = 0.0
        for repeat, dealt in enumerate(repeats):
            for fold in range(n_splits):
                model = build(params).fit(dealt.where(F.col("fold") != fold))
                out = model.transform(dealt.where(F.col("fold") == fold))
                for metric, score in scoring.items():
                    value = float(score(out))
                    rows.append((str(params), repeat, fold, metric, value))
                    total += value if metric == refit else 0.0
        means.append((-total / (n_repeats * n_splits), n))
    best = dict(grid[min(means)[1]])
    model = build(best).fit(ready)
    if modeltype == "clf":
        best["threshold"] = youden(roc_curve(scored(model, ready), "link_probability", label)).first()["threshold"]
    return best, model, df.sparkSession.createDataFrame(rows, "params string, repeat int, fold int, metric string, score double")


def marginals(cv: DataFrame, params: list[str]) -> DataFrame:
    """``param, value, mean, std`` (of the population) of the scores by each parameter's values."""
    long = cv.select(F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params))).alias("x"), "score").select("x.*", "score")
    return long.groupBy("param", "value").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def confusion(df: DataFrame, label: str = "link", predicted: str = "predicted") -> DataFrame:
    """``label, predicted, n`` of the combinations there are."""
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def metrics(df: DataFrame, label: str = "link", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall, F1 and the area under the curve of hard labels; 0 where a share has no base."""
    def count(condition: str):
        return F.sum(F.expr(f"cast({condition} as double)"))

    y, p = f"`{label}`", f"`{predicted}`"
    sums = df.agg(count(f"{y} = 1 and {p} = 1").alias("tp"), count(f"{y} = 0 and {p} = 1").alias("fp"), count(f"{y} = 1 and {p} = 0").alias("fn"), count(f"{y} = 0 and {p} = 0").alias("tn"))

    def share(a: str, b: str):
        return F.expr(f"case when {b} = 0 then 0D else ({a}) / ({b}) end")

    return sums.select(
        share("tp + tn", "tp + tn + fp + fn").alias("accuracy"),
        share("tp", "tp + fp").alias("precision"),
        share("tp", "tp + fn").alias("recall"),
        share("2 * tp", "2 * tp + fp + fn").alias("f1"),
        ((share("tp", "tp + fn") + share("tn", "tn + fp")) / 2).alias("roc_auc_hard"),
    )


def roc_curve(df: DataFrame, score: str, label: str = "link") -> DataFrame:
    """``threshold, tp, fp, tpr, fpr`` at each distinct score; rates are 0 without a base.

    Counts by score are dealt by ranges of the score; each range adds up its
    own, and the sums before it come from a row for each range.
    """
    by = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.expr(f"cast(`{label}` = 1 as bigint)")).alias("p"), F.sum(F.expr(f"cast(`{label}` = 0 as bigint)")).alias("n"))
    ranged = written(by.repartitionByRange(F.desc("threshold")).withColumn("part", F.spark_partition_id()), "scores")
    totals = ranged.groupBy("part").agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    before, whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = totals.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("ps", "ns")), *(F.sum(c).over(whole).alias(c) for c in ("ps", "ns")))
    down = Window.partitionBy("part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("tp", F.sum("p").over(down)).withColumn("fp", F.sum("n").over(down)).join(F.broadcast(earlier), "part")
    run = run.withColumn("tp", F.col("tp") + F.col("ps_before")).withColumn("fp", F.col("fp") + F.col("ns_before"))
    return run.select("threshold", "tp", "fp", F.expr("case when ps = 0 then 0D else tp / ps end").alias("tpr"), F.expr("case when ns = 0 then 0D else fp / ns end").alias("fpr"))


def youden(curve: DataFrame) -> DataFrame:
    """One row, ``threshold, j``: the highest score where the rates are furthest apart, to 12 places."""
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("j"), "threshold")).alias("x")
    return curve.agg(best).select("x.threshold", "x.j")
