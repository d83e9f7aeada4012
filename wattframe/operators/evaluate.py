"""Evaluation: RMSE / mean / std matrices and classification metrics, as grouped aggregations.

Forecast comparisons are done in long form — one row per (model, target, time) with actual and
predicted — so any number of models and targets is one ``groupBy``.  Classification metrics come
from a confusion table (one grouped count, k² rows), never from collected predictions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rmse_column(actual, pred) -> Column:
    return F.sqrt(F.avg(F.pow(_c(actual) - _c(pred), 2)))


def stack_predictions(df: DataFrame, key, pairs: dict, model_col: str = "model",
                      target_col: str = "target") -> DataFrame:
    """Wide prediction table → long (key, model, target, actual, predicted).

    ``pairs``: ``{(model, target): (actual_col, predicted_col)}``.  One ``stack`` generator, no union.
    """
    ks = [key] if isinstance(key, str) else list(key)
    entries = []
    for (model, target), (a, p) in pairs.items():
        entries += [F.lit(model), F.lit(target), F.col(a).cast("double"), F.col(p).cast("double")]
    n = len(pairs)
    stacked = F.inline(F.array(*[F.struct(entries[i * 4].alias(model_col), entries[i * 4 + 1].alias(target_col),
                                          entries[i * 4 + 2].alias("actual"), entries[i * 4 + 3].alias("predicted"))
                                 for i in range(n)]))
    return df.select(*ks, stacked)


def rmse_matrix(long: DataFrame, group=("model", "target"), actual: str = "actual",
                predicted: str = "predicted", digits: int = 4) -> DataFrame:
    """RMSE per (model, target) rounded to ``digits``; pairs with a null side are skipped and counted."""
    g = list(group)
    both = F.col(actual).isNotNull() & F.col(predicted).isNotNull()
    err2 = F.when(both, F.pow(F.col(actual) - F.col(predicted), 2))
    return long.groupBy(*g).agg(F.round(F.sqrt(F.avg(err2)), digits).alias("rmse"),
                                F.count_if(both).alias("n_pairs"),
                                F.count_if(~both).alias("n_null_pairs"))


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def mean_std_matrix(long: DataFrame, group=("series",), value: str = "value", digits: int | None = None) -> DataFrame:
    """Mean and sample standard deviation per group (nulls skipped), optionally rounded."""
    g = list(group)
    return long.groupBy(*g).agg(_round(F.avg(value), digits).alias("mean"),
                                _round(F.stddev_samp(value), digits).alias("std"),
                                F.count(value).alias("n"))


def rmse_wide(df: DataFrame, pairs: dict, digits: int = 4) -> DataFrame:
    """RMSE per (model, target) straight from a wide prediction table: one aggregation pass with one
    expression per pair (no row expansion), then the single result row is reshaped to long form."""
    aggs, entries = [], []
    for i, ((model, target), (a, p)) in enumerate(pairs.items()):
        both = F.col(a).isNotNull() & F.col(p).isNotNull()
        aggs += [F.round(F.sqrt(F.avg(F.when(both, F.pow(F.col(a) - F.col(p), 2)))), digits).alias(f"r{i}"),
                 F.count_if(both).alias(f"n{i}"), F.count_if(~both).alias(f"z{i}")]
        entries.append((F.lit(model), F.lit(target), F.col(f"r{i}"), F.col(f"n{i}"), F.col(f"z{i}")))
    one = df.agg(*aggs)
    names = ["model", "target", "rmse", "n_pairs", "n_null_pairs"]
    return one.select(F.inline(F.array(*[F.struct(*[v.alias(n) for v, n in zip(e, names)]) for e in entries])))


def mean_std_wide(df: DataFrame, cols: list[str], series_col: str = "series") -> DataFrame:
    """Mean, sample std and count of each column in one aggregation pass (no unpivot of the rows)."""
    aggs, entries = [], []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"), F.count(c).alias(f"n{i}")]
        entries.append((F.lit(c), F.col(f"m{i}"), F.col(f"s{i}"), F.col(f"n{i}")))
    one = df.agg(*aggs)
    names = [series_col, "mean", "std", "n"]
    return one.select(F.inline(F.array(*[F.struct(*[v.alias(n) for v, n in zip(e, names)]) for e in entries])))


def error_direction(pred: DataFrame, label_idx: str, pred_idx: str, class_col: str) -> DataFrame:
    """Rows per (sign of prediction − label, class): ``pos_diff`` / ``neg_diff`` / ``same``."""
    diff = F.col(pred_idx) - F.col(label_idx)
    sign = F.when(diff > 0, "pos_diff").when(diff < 0, "neg_diff").otherwise("same")
    return pred.groupBy(sign.alias("pred_label_diff"), F.col(class_col)).agg(F.count(F.lit(1)).alias("count"))


def confusion(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, label: str, prediction: str, digits: int | None = None,
                           label_first: bool = False) -> DataFrame:
    """Per-label precision / recall / F1 and overall accuracy, micro P/R/F1, Hamming loss and
    subset accuracy, for one label and one prediction per row (long form: metric, label, value).

    With one label per row the document-averaged precision, recall and F1 and the subset accuracy all
    equal the accuracy; Hamming loss is 2·errors / (rows · distinct labels), where a class that is only
    predicted is no label.  ``label_first`` swaps per-label precision and recall: it gives the numbers of
    an evaluator that is handed (label, prediction) pairs where (prediction, label) is meant.
    """
    p_name, r_name = ("recall", "precision") if label_first else ("precision", "recall")
    cm = confusion(pred, label, prediction)
    # every confusion cell counts once for its true label and once for its predicted label:
    # one aggregation gives tp, label and prediction totals per class (no outer join needed)
    roles = F.array(F.struct(F.col("label").alias("cls"), F.col("n").alias("as_label"), F.lit(0).cast("long").alias("as_pred"),
                             F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp")),
                    F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("as_label"),
                             F.col("n").alias("as_pred"), F.lit(0).cast("long").alias("tp")))
    per = cm.select(F.inline(roles)).groupBy("cls").agg(
        F.sum("tp").alias("tp"), F.sum("as_label").alias("n_label"), F.sum("as_pred").alias("n_pred"))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_label") > 0, F.col("tp") / F.col("n_label")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    per_label = per.select(F.col("cls").cast("string").alias("label"),
                           _round(prec, digits).alias(p_name), _round(rec, digits).alias(r_name),
                           _round(f1, digits).alias("f1"))
    per_label_long = per_label.unpivot(["label"], ["precision", "recall", "f1"], "metric", "value")
    tot = per.agg(F.sum("tp").alias("hits"), F.sum("n_label").alias("rows"), F.count_if(F.col("n_label") > 0).alias("n_labels"))
    n_labels = F.col("n_labels")
    acc = F.col("hits") / F.col("rows")
    overall = tot.select(
        *[_round(acc, digits).alias(m) for m in ("accuracy", "precision", "recall", "f1", "micro_precision",
                                                 "micro_recall", "micro_f1", "subset_accuracy")],
        _round(2 * (F.col("rows") - F.col("hits")) / (F.col("rows") * n_labels), digits).alias("hamming_loss"))
    overall_long = overall.unpivot([], overall.columns, "metric", "value").select(
        F.lit("ALL").alias("label"), "metric", "value")
    return per_label_long.select("label", "metric", "value").unionByName(overall_long)


__all__ = ["rmse_column", "stack_predictions", "rmse_matrix", "rmse_wide", "mean_std_matrix", "mean_std_wide", "error_direction",
           "confusion", "classification_metrics"]
