"""Forecasting on the joined hourly table with Spark ML.

* ``forecast_trees`` — boosted trees per target, trained outside the test year, predicting it;
* ``cv_curve`` — per-round train/test RMSE over shuffled k folds, truncated at the best round with
  early stopping;
* ``split_importance`` — how often each feature is used to split, read from the saved model's node
  table, next to Spark's gain importance;
* ``tune_trees`` — grid over learning rate × depth with k-fold cross-validation;
* ``forecast_from_history`` — a regressor over the previous ``history`` rows (scaled, PCA-reduced
  features plus the scaled target); trees keep their best round on a validation range (patience);
* ``compare_models`` — RMSE, mean and standard deviation of every model and the published forecast.

Trees grow with ``operators.boosting``: all targets, folds and grid points in one job per level.  Only
``split_importance`` and the history model use Spark's ``GBTRegressor`` (learning rate → ``stepSize``, rounds →
``maxIter``, ``min_child_weight`` → ``minInstancesPerNode``, row subsample → ``subsamplingRate``, column subsample →
``featureSubsetStrategy``, drawn per node; no L1 leaf penalty).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.columns import columns_of_type
from wattframe.operators import boosting
from wattframe.operators.boosting import Boost
from wattframe.operators.evaluate import mean_std_wide, rmse_wide
from wattframe.operators.features import FIT_PARTITIONS, fit_centred_pca, fit_minmax, stable_layout
from wattframe.operators.positions import positional_folds
from wattframe.operators.sampling import shuffled_folds, time_split_label, year_split
from wattframe.operators.sequences import build_sequences, hour_index
from wattframe.schemas import BEST_TREE_PARAMS, HISTORY_SPLITS, HISTORY_WINDOW, TEST_YEAR, TREE_COMMON
from wattframe.session import cut_lineage, scratch_path

NUMERIC = ("double", "float", "int", "bigint")


def feature_columns(df: DataFrame, target: str, ts_col: str, exclude: list[str] | None = None) -> list[str]:
    """Every numeric column except the target (other targets stay, as in the source)."""
    skip = {target, ts_col, *(exclude or [])}
    return [c for c in columns_of_type(df, *NUMERIC) if c not in skip]


def gbt(target: str, learning_rate: float = 0.07, max_depth: int = 5, n_estimators: int = 500,
        min_child_weight: int = TREE_COMMON["min_child_weight"], subsample: float = TREE_COMMON["subsample"],
        colsample: float = TREE_COMMON["colsample_bytree"], alpha: float = 0.0, seed: int = 42) -> GBTRegressor:
    """``alpha``, an L1 penalty of leaf values, has no counterpart in Spark; only 0 is accepted."""
    if alpha:
        raise ValueError("GBTRegressor has no L1 leaf penalty; alpha must be 0")
    return GBTRegressor(labelCol=target, featuresCol="features", stepSize=learning_rate, maxDepth=max_depth,
                        maxIter=n_estimators, minInstancesPerNode=min_child_weight, subsamplingRate=subsample,
                        featureSubsetStrategy=str(colsample), lossType="squared", seed=seed)


def _assembler(cols):
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep")


def model_input_once(df: DataFrame) -> DataFrame:
    """Materialise a model input read many times (fits, splits, per-round evaluation) once, as a
    reliable checkpoint in the shared folder: later reads are file scans, not recomputations of the
    pipeline that produced it, and a lost executor does not send that pipeline back to work."""
    return cut_lineage(df)


def forecast_trees(df: DataFrame, ts_col: str, target: str, test_year: int = TEST_YEAR, params: dict | None = None,
                   exclude: list[str] | None = None) -> DataFrame:
    """The whole test-year frame with ``<target>_predicted``.  The prediction stays keyed by time
    (``transform`` carries the row), so re-attaching it is a join, never a positional paste."""
    params = params if params is not None else BEST_TREE_PARAMS.get(target, {})
    train, test = year_split(df, ts_col, test_year)
    model = boosting.fit(train, [ts_col], feature_columns(df, target, ts_col, exclude), [Boost(target, target, **params)])
    return model.transform(test, {target: f"{target}_predicted"})


def forecast_targets(df: DataFrame, ts_col: str, targets: dict, test_year: int = TEST_YEAR,
                     params_by_target: dict = BEST_TREE_PARAMS, set_aside: DataFrame | None = None, state: str | None = None) -> DataFrame:
    """The test-year frame with all targets' predictions, joined on time, plus the set-aside block.  The targets' trees
    grow together; with ``state`` (a shared folder) a fit that was broken off goes on from its last written round."""
    df = model_input_once(df)
    train, test = year_split(df, ts_col, test_year)
    models = [Boost(t, t, skip=(t,), **params_by_target[t]) for t in targets]
    fitted = boosting.fit(train, [ts_col], feature_columns(df, "", ts_col), models, state=state)
    return forecast_frame(df, ts_col, test_year, [fitted.transform(test, targets).select(ts_col, *targets.values())], set_aside)


def forecast_frame(df: DataFrame, ts_col: str, test_year: int, predictions: list[DataFrame], set_aside: DataFrame | None = None) -> DataFrame:
    """The test-year rows with the predictions (each keyed by time) and the set-aside columns joined on time."""
    out = year_split(df, ts_col, test_year)[1]
    for p in predictions:
        out = out.join(p, ts_col, "inner")
    if set_aside is not None:
        _, aside_test = year_split(set_aside, ts_col, test_year)
        out = out.join(aside_test, ts_col, "left")
    return out


def _scope(df: DataFrame, ts_col: str, fit_scope: str, test_year: int | None) -> DataFrame:
    """``"all"`` fits on every row (as the source does, test year included); ``"train"`` leaves the
    test year out."""
    if fit_scope not in ("all", "train"):
        raise ValueError("fit_scope must be 'all' or 'train'")
    if fit_scope == "train":
        if test_year is None:
            raise ValueError("fit_scope='train' needs test_year")
        return year_split(df, ts_col, test_year)[0]
    return df


def cv_curve(df: DataFrame, ts_col: str, target: str, params: dict, k: int = 3, rounds: int = 50,
             early_stop: int = 10, seed: int = 123, key_cols: list[str] | None = None,
             fit_scope: str = "all", test_year: int | None = None, state: str | None = None) -> DataFrame:
    """Per boosting round: mean / std (population) of train and test RMSE over shuffled k folds, up to the best round.

    The folds' models grow together and stop once the mean test RMSE hasn't improved for ``early_stop`` rounds.
    """
    df = _scope(df, ts_col, fit_scope, test_year)
    cols = feature_columns(df, target, ts_col)
    fold = shuffled_folds(key_cols or [ts_col], k, seed)
    df = model_input_once(df.select(ts_col, target, *cols, *[(fold == f).alias(f"_out{f}") for f in range(k)]))
    models = [Boost(f"fold{f}", target, holdout=f"_out{f}", group="cv", seed=seed, **dict(params, n_estimators=rounds)) for f in range(k)]
    fitted = boosting.fit(df, [ts_col], cols, models, early_stop=early_stop, state=state)
    best = max(map(len, fitted.trees))
    return boosting.error_table(df.sparkSession, fitted).filter(F.col("round") < best).groupBy("round").agg(
        F.avg("train_rmse").alias("train_rmse_mean"), F.stddev_pop("train_rmse").alias("train_rmse_std"),
        F.avg("test_rmse").alias("test_rmse_mean"), F.stddev_pop("test_rmse").alias("test_rmse_std"))


def split_importance(df: DataFrame, ts_col: str, target: str, params: dict, rounds: int = 10,
                     fit_scope: str = "all", test_year: int | None = None, partitions: int = FIT_PARTITIONS) -> DataFrame:
    """(feature, split_count, gain_importance) of a ``rounds``-tree model fitted on all rows.

    The split count is read from the saved model's node table (one row per node; internal nodes have
    a left child) with a grouped count — no tree is walked on the driver.
    """
    spark = df.sparkSession
    df = _scope(df, ts_col, fit_scope, test_year)
    cols = feature_columns(df, target, ts_col)
    df = model_input_once(df.select(ts_col, target, *cols))
    model = gbt(target, **dict(params, n_estimators=rounds)).fit(_assembler(cols).transform(stable_layout(df, [ts_col], partitions)))
    path = scratch_path(spark, "models", "gbt")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    counts = (nodes.filter(F.col("nodeData.leftChild") >= 0)
              .groupBy(F.col("nodeData.split.featureIndex").alias("feature_index"))
              .agg(F.count(F.lit(1)).alias("split_count")))
    gains = model.featureImportances.toArray().tolist()
    names = spark.createDataFrame([(i, c, float(gains[i])) for i, c in enumerate(cols)],
                                  "feature_index int, feature string, gain_importance double")
    return (names.join(counts, "feature_index", "left").na.fill(0, ["split_count"])
            .select("feature", F.col("split_count").cast("long"), "gain_importance"))


def tune_trees(df: DataFrame, ts_col: str, target: str, grid: dict, folds: int = 2, n_estimators: int = 500,
               test_year: int | None = None, metric: str = "r2", fit_scope: str = "all"):
    """Grid over learning rate × depth, k-fold CV with consecutive folds of equal row counts.

    All grid points' and folds' trees grow together.  Returns (scores per grid point, best params, test RMSE of the
    best params refitted outside ``test_year``).  ``fit_scope="train"`` keeps the test year out of the search as well.
    """
    if metric not in ("r2", "rmse"):
        raise ValueError("metric must be 'r2' or 'rmse'")
    spark, cols = df.sparkSession, feature_columns(df, target, ts_col)
    df = model_input_once(df.select(ts_col, target, *cols))
    data = year_split(df, ts_col, test_year)[0] if fit_scope == "train" and test_year is not None else df
    outs = [(F.col("_fold") == f).alias(f"_out{f}") for f in range(folds)]
    data = model_input_once(positional_folds(data, [ts_col], folds, "_fold").select("*", *outs))
    points = [(lr, depth) for lr in grid["learning_rate"] for depth in grid["max_depth"]]
    models = [Boost(f"{lr}/{depth}/{f}", target, lr, depth, n_estimators, holdout=f"_out{f}") for lr, depth in points for f in range(folds)]
    fitted = boosting.fit(data, [ts_col], cols, models)
    rmse = {name: held for name, r, _, held in fitted.errors if r == n_estimators - 1}
    spread = {r["_fold"]: r["v"] for r in data.groupBy("_fold").agg(F.var_pop(target).alias("v")).collect()}

    def score(lr, depth, f):
        e = rmse[f"{lr}/{depth}/{f}"]
        return e if metric == "rmse" else 1 - e * e / spread[f]

    means = [sum(score(*p, f) for f in range(folds)) / folds for p in points]
    scores = spark.createDataFrame([(float(lr), int(depth), float(s)) for (lr, depth), s in zip(points, means)],
                                   f"learning_rate double, max_depth int, {metric} double")
    best_i = (max if metric == "r2" else min)(range(len(points)), key=means.__getitem__)
    best = {"learning_rate": float(points[best_i][0]), "max_depth": int(points[best_i][1]), "n_estimators": n_estimators}
    test_rmse = None
    if test_year is not None:
        pred = forecast_trees(df, ts_col, target, test_year, best)
        test_rmse = pred.select(F.sqrt(F.avg(F.pow(F.col(target) - F.col(f"{target}_predicted"), 2)))).first()[0]
    return scores, best, test_rmse


def forecast_from_history(df: DataFrame, ts_col: str, target: str, boundaries: list = HISTORY_SPLITS,
                          history: int = HISTORY_WINDOW,
                          variance: float = 0.80, unit_seconds: int = 3600, model: str = "linear",
                          max_iter: int = 50, exclude: list[str] | None = None, patience: int = 10,
                          partitions: int = FIT_PARTITIONS):
    """Predict the target of every test row from the ``history`` rows before it.

    Rows get a split label by time (train / validation / test); scalers and PCA are fitted on train;
    each row's vector is [PCA scores..., scaled target]; sequences never cross a split; the
    regressor sees the flattened sequence.  ``model="gbt"`` keeps the best number of rounds on the
    validation range with ``patience``.  Returns (test predictions in original units,
    train / validation RMSE in original units, per-iteration training history).
    """
    cols = feature_columns(df, target, ts_col, exclude)
    lab = model_input_once(df.select(ts_col, target, *cols).withColumn("split", time_split_label(ts_col, boundaries)))
    train = lab.filter(F.col("split") == "train")
    sx = fit_minmax(train, cols)
    sy = fit_minmax(train, [target], drop_constant=False)
    cols = sx.columns
    scaled = sy.transform(sx.transform(lab, "_s"), "_s")
    scaled = VectorAssembler(inputCols=[c + "_s" for c in cols], outputCol="xs", handleInvalid="keep").transform(scaled)
    pca = fit_centred_pca(scaled.filter(F.col("split") == "train"), "xs", "xp", variance)
    proj = pca.transform(scaled, "xs", "xp")
    t0 = lab.select(F.min(ts_col)).scalar()
    rows = hour_index(proj, ts_col, t0, unit_seconds).withColumn(
        "row", F.concat(vector_to_array("xp"), F.array(F.col(f"{target}_s"))))
    # the target row's time and value travel with its label
    rows = rows.withColumn("_label", F.struct(F.col(f"{target}_s").alias("y"), F.col(ts_col).alias("ts"), F.col(target).alias("actual")))
    seq = build_sequences(rows, "idx", "row", "_label", history, split_col="split")
    seq = seq.select("split", "idx", F.col("label.y").alias("label"), F.col("label.ts").alias(ts_col), F.col("label.actual").alias(target),
                     array_to_vector(F.flatten("history")).alias("features"))
    seq = model_input_once(seq)
    fit_rows = stable_layout(seq.filter(F.col("split") != "test"), ["split", "idx"], partitions)
    if model == "linear":
        reg = LinearRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=1e-4)
        m = reg.fit(fit_rows.filter(F.col("split") == "train"))
    else:
        # best round kept, patience-style: fit all rounds on train, read the validation error after
        # every round (one pass), stop looking once `patience` rounds bring no improvement, refit
        # with the best number of rounds (same seed and layout give the same first trees)
        train_rows = fit_rows.filter(F.col("split") == "train")
        full = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, seed=42).fit(train_rows)
        val_err = full.evaluateEachIteration(fit_rows.filter(F.col("split") == "validation"), "squared")
        best, best_v = 0, float("inf")
        for i, v in enumerate(val_err):
            if v < best_v:
                best, best_v = i, v
            elif i - best >= patience:
                break
        m = full if best + 1 == len(val_err) else \
            GBTRegressor(featuresCol="features", labelCol="label", maxIter=best + 1, seed=42).fit(train_rows)
    pred = m.transform(seq)
    out = pred.select(
        ts_col, "split", target, sy.inverse_column("prediction", target).alias(f"{target}_predicted"))
    errors = pred.filter(F.col("split") != "test").groupBy("split").agg(
        sy.inverse_error(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))), target).alias("rmse"))
    history = _training_history(df.sparkSession, m, model, fit_rows, sy, target)
    return out.filter(F.col("split") == "test").drop("split"), errors, history


def forecast_history_targets(df: DataFrame, ts_col: str, targets: dict[str, str], parallelism: int = 4, **how) -> DataFrame:
    """One row per test time: every target with its prediction from the history model (``targets`` maps target to
    prediction column); settings as in :func:`forecast_from_history`."""
    df = model_input_once(df)

    def one(item):
        target, name = item
        pred, _, _ = forecast_from_history(df, ts_col, target, **how)
        return pred.withColumnRenamed(f"{target}_predicted", name)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(targets)))) as pool:
        parts = list(pool.map(one, targets.items()))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ts_col, "inner")
    return out


def tuning_report(scores: DataFrame, best: dict, test_rmse: float | None) -> DataFrame:
    """The grid's scores with the chosen point marked and its test RMSE after the refit."""
    chosen = (F.col("learning_rate") == best["learning_rate"]) & (F.col("max_depth") == best["max_depth"])
    return scores.withColumns({"best": chosen, "test_rmse": F.when(chosen, F.lit(test_rmse).cast("double"))})


def comparison_report(preds: DataFrame, pairs: dict) -> DataFrame:
    """Both matrices as one long table: RMSE per (model, target), mean and std of every series."""
    rm, ms = compare_models(preds, None, pairs)
    none = F.lit(None).cast("double")
    return rm.select(F.lit("rmse").alias("part"), "model", F.col("target").alias("series"), "rmse", none.alias("mean"), none.alias("std"),
                     F.col("n_pairs").alias("n")).unionByName(
        ms.select(F.lit("mean_std").alias("part"), F.lit(None).cast("string").alias("model"), "series", none.alias("rmse"), "mean", "std", "n"))


def _training_history(spark, m, model: str, fit_rows: DataFrame, sy, target: str) -> DataFrame:
    """Per-iteration training history in original units: for trees the train / validation RMSE after
    every round (one pass per split), for the linear model its objective per iteration.  An error
    scales back by the range factor only (no offset)."""
    factor = (sy.maxs[target] - sy.mins[target]) / (sy.hi - sy.lo)
    rows = []
    if model == "linear":
        for i, v in enumerate(m.summary.objectiveHistory):
            rows.append((i, "train", "objective", float(v)))
    else:
        for split in ("train", "validation"):
            part = fit_rows.filter(F.col("split") == split)
            for i, v in enumerate(m.evaluateEachIteration(part, "squared")):
                rows.append((i, split, "rmse", math.sqrt(v) * factor))
    return spark.createDataFrame(rows, "iteration int, split string, metric string, value double")


def compare_models(preds: DataFrame, key, pairs: dict, series: dict | None = None):
    """(RMSE matrix, mean/std matrix).  ``pairs``: {(model, target): (actual, predicted)};
    ``series``: {name: column} whose mean and std are reported (defaults to every column in pairs)."""
    rm = rmse_wide(preds, pairs)
    series = series or {c: c for pair in pairs.values() for c in pair}
    wide = preds.select(*[F.col(c).cast("double").alias(n) for n, c in series.items()])
    return rm, mean_std_wide(wide, list(series))


__all__ = ["model_input_once", "feature_columns", "gbt", "forecast_trees", "forecast_targets", "forecast_frame", "cv_curve", "split_importance",
           "tune_trees", "tuning_report", "forecast_from_history", "forecast_history_targets", "compare_models", "comparison_report"]
