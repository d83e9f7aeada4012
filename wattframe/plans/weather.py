"""Weather de-duplication: per-entity classifier, three-case selector, merge, wide table.

Flow for a long table (key, entity, measures, class, class id):

1. ``duplicate_counts`` — (key, entity) pairs repeated, and from them the keys repeated in any entity;
2. per entity: training rows = that entity's rows at keys repeated in **no** entity (anti join),
   capped per class by a repeatable balanced sample; rows to predict = that entity's rows at keys
   it repeats itself (semi join);
3. fit ``VectorAssembler → StringIndexer → classifier → IndexToString`` and predict;
4. ``select_predicted`` over all entities at once, keep flag 1, ``merge_resolved`` with the
   originals, ``to_wide``.

Only step 3 is per entity (one model per entity, as the source does); the fits run concurrently on
a small thread pool, each one a distributed Spark ML job.  Everything else treats all entities in
one plan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import IndexToString, Normalizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions.text import normalised_equals
from wattframe.operators.evaluate import classification_metrics, error_direction
from wattframe.operators.joins import keyed_join, semi_join
from wattframe.operators.profile import duplicate_counts
from wattframe.operators.resolve import merge_resolved, select_predicted
from wattframe.operators.reshape import to_wide
from wattframe.operators.sampling import balanced_sample, hash_split
from wattframe.operators.features import FIT_PARTITIONS, stable_layout
from wattframe.schemas import BALANCED_CAP
from wattframe.session import cut_lineage


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def make_classifier(name: str, n_inputs: int, n_classes: int, seed: int = 42):
    """The four classifiers compared in the source; ``rf`` is the one used for resolution."""
    if name == "rf":
        return RandomForestClassifier(labelCol="label", featuresCol="features", seed=seed)
    if name == "dt":
        return DecisionTreeClassifier(labelCol="label", featuresCol="features", seed=seed)
    if name == "lr":
        return LogisticRegression(labelCol="label", featuresCol="features", maxIter=10, regParam=0.001)
    if name == "mlp":
        return MultilayerPerceptronClassifier(labelCol="label", featuresCol="features",
                                              layers=[n_inputs, 10, 8, 10, max(n_classes, 2)],
                                              blockSize=128, seed=1234, maxIter=100)
    raise ValueError(f"unknown classifier {name!r}")


def clean_rows(df: DataFrame, key, duplicated_keys: DataFrame) -> DataFrame:
    """Rows at keys that are repeated in no entity (NOT EXISTS)."""
    return semi_join(df, duplicated_keys, _keys(key), anti=True)


def repeated_rows(df: DataFrame, key, entity: str, min_count: int = 2) -> DataFrame:
    """Rows whose (key, entity) occurs at least ``min_count`` times (EXISTS)."""
    ks = _keys(key)
    return semi_join(df, duplicate_counts(df, ks, entity, min_count), ks + [entity])


def fit_class_model(train: DataFrame, inputs: list[str], label_col: str, classifier: str = "rf",
                    cap: int = BALANCED_CAP, id_cols: list[str] | None = None, seed: int = 42,
                    normalise: bool = False, handle_invalid: str = "keep",
                    partitions: int = FIT_PARTITIONS) -> PipelineModel | NoClassModel:
    """Label order from all training rows; the classifier sees at most ``cap`` rows per class.  Without a labelled
    training row (every key may be repeated) the model is a :class:`NoClassModel`."""
    sample, indexer = class_sample(train, label_col, cap, id_cols, seed, partitions)
    return _fit_class(sample, indexer, inputs, classifier, seed, normalise, handle_invalid)


def class_sample(train: DataFrame, label_col: str, cap: int = BALANCED_CAP, id_cols: list[str] | None = None, seed: int = 42,
                 partitions: int = FIT_PARTITIONS):
    """The balanced sample in a fixed layout and the label order, as any number of classifiers can share them."""
    indexer = StringIndexer(inputCol=label_col, outputCol="label", handleInvalid="keep").fit(train)
    sample = balanced_sample(train, label_col, cap, id_cols, seed)
    return stable_layout(sample, id_cols or sample.columns, partitions), indexer


@dataclass
class NoClassModel:
    """Stands for a model where no labelled row was there to learn from: nothing can be predicted, so label and
    prediction are null in every row.  The columns are those of a fitted model."""
    inputs: list[str]
    normalise: bool = False
    handle_invalid: str = "keep"

    def transform(self, rows: DataFrame) -> DataFrame:
        stages = _feature_stages(self.inputs, self.normalise, self.handle_invalid)
        vector, number = F.lit(None).cast(VectorUDT()), F.lit(None).cast("double")
        return reduce(lambda df, stage: stage.transform(df), stages, rows).select(
            "*", number.alias("label"), vector.alias("rawPrediction"), vector.alias("probability"), number.alias("prediction"),
            F.lit(None).cast("string").alias("predictedLabel"))


def _feature_stages(inputs, normalise, handle_invalid) -> list:
    feats = "features_raw" if normalise else "features"
    stages = [VectorAssembler(inputCols=inputs, outputCol=feats, handleInvalid=handle_invalid)]
    return stages + [Normalizer(inputCol=feats, outputCol="features")] * normalise


def _fit_class(sample, indexer, inputs, classifier, seed, normalise, handle_invalid="keep") -> PipelineModel | NoClassModel:
    if not indexer.labels:
        return NoClassModel(inputs, normalise, handle_invalid)
    stages = [*_feature_stages(inputs, normalise, handle_invalid), indexer,
              make_classifier(classifier, len(inputs), len(indexer.labels), seed),
              IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=indexer.labels)]
    return Pipeline(stages=stages).fit(sample)


def training_rows(rows: DataFrame, inputs: list[str], nulls: str = "drop", fill: float = 0.0) -> DataFrame:
    """Training rows with null features dropped (as the source does), filled, or kept for the assembler."""
    if nulls == "drop":
        return rows.na.drop(subset=inputs)
    if nulls == "fill":
        return rows.na.fill(fill, subset=inputs)
    if nulls == "keep":
        return rows
    raise ValueError("nulls must be 'drop', 'fill' or 'keep'")


def _entity_frames(df, key, entity, value, dup_keys):
    mine = df.filter(normalised_equals(entity, value))
    return clean_rows(mine, key, dup_keys), repeated_rows(mine, key, entity)


def predict_duplicates(df: DataFrame, key, entity: str, value: str, inputs: list[str], label_col: str,
                       dup_keys: DataFrame, classifier: str = "rf", cap: int = BALANCED_CAP,
                       id_cols: list[str] | None = None, seed: int = 42, fill_features: float | None = 0.0,
                       train_nulls: str = "drop"):
    """Fit on one entity's clean rows, predict its repeated rows (adds prediction, predictedLabel; null where the
    entity has no labelled clean row)."""
    train, todo = _entity_frames(df, key, entity, value, dup_keys)
    model = fit_class_model(training_rows(train, inputs, train_nulls), inputs, label_col, classifier, cap, id_cols, seed)
    if fill_features is not None:
        todo = todo.na.fill(fill_features, subset=inputs)
    return model.transform(todo)


def train_and_evaluate_classifier(df: DataFrame, key, entity: str, value: str, inputs: list[str],
                                  label_col: str, dup_keys: DataFrame, classifier: str | list[str] = "rf",
                                  cap: int = BALANCED_CAP, id_cols: list[str] | None = None,
                                  seed: int = 42, fraction: float = 0.6, train_nulls: str = "drop",
                                  normalise: bool = False):
    """Hold out ``1 - fraction`` of one entity's clean rows; return (predictions, metrics, direction).

    With a list of classifiers the entity's rows are found and written once for all of them, the sample and the
    label order are made once, and the three results are dictionaries by classifier.  Without a labelled row to fit
    on, predictions are null and not judged: no per-label metrics, overall ones null, no direction.
    """
    names = [classifier] if isinstance(classifier, str) else list(classifier)
    train_all, _ = _entity_frames(df, key, entity, value, dup_keys)
    train_all = training_rows(train_all, inputs, train_nulls)
    if len(names) > 1:
        train_all = cut_lineage(train_all)
    fit_rows, held = hash_split(train_all, id_cols or _keys(key), fraction, seed)
    sample, indexer = class_sample(fit_rows, label_col, cap, id_cols, seed)
    sample = sample.persist(StorageLevel.MEMORY_AND_DISK)

    def one(name):
        model = _fit_class(sample, indexer, inputs, name, seed, normalise)
        # the metrics read the predictions several times
        pred = cut_lineage(model.transform(held))
        judged = pred.filter(F.col("prediction").isNotNull()) if isinstance(model, NoClassModel) else pred
        return (pred, classification_metrics(judged, "label", "prediction"),
                error_direction(judged, "label", "prediction", label_col))

    with ThreadPoolExecutor(max_workers=min(4, len(names))) as pool:  # independent distributed fits
        found = list(pool.map(one, names))
    sample.unpersist()
    if isinstance(classifier, str):
        return found[0]
    return tuple({n: r[i] for n, r in zip(names, found)} for i in range(3))


def label_orders(rows: DataFrame, entity: str, label_col: str) -> dict[str, list[str]]:
    """Per entity, labels by frequency (desc) then label (asc) — StringIndexer's order — from one
    grouped count over all entities (entities × classes rows reach the driver)."""
    counts = rows.groupBy(entity, label_col).agg(F.count(F.lit(1)).alias("n")).collect()
    out: dict[str, list] = {}
    for r in counts:
        if r[label_col] is not None:
            out.setdefault(r[entity], []).append((-r["n"], r[label_col]))
    return {e: [lab for _, lab in sorted(v)] for e, v in out.items()}


def _fit_from_sample(sample: DataFrame, labels: list[str], inputs: list[str], label_col: str,
                     classifier: str, seed: int) -> PipelineModel:
    indexer = StringIndexerModel.from_labels(labels, inputCol=label_col, outputCol="label", handleInvalid="keep")
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"), indexer,
              make_classifier(classifier, len(inputs), len(labels), seed),
              IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=labels)]
    return Pipeline(stages=stages).fit(sample)


def resolve_duplicates(df: DataFrame, key, entity: str, entities: list[str], inputs: list[str],
                       label_col: str, id_col: str, id_map: dict, row_id: str, classifier: str = "rf",
                       cap: int = BALANCED_CAP, seed: int = 42, rule: str = "running",
                       parallelism: int = 5, fill_features: float | None = 0.0,
                       train_nulls: str = "drop", partitions: int = FIT_PARTITIONS):
    """Returns ``(selected, merged)``: the flagged predictions of every repeated row, and the long
    table with one resolved row per (key, entity) wherever the selector kept one.

    The number of passes over ``df`` does not grow with the number of entities: repeated keys, clean
    rows, repeated rows, the per-(entity, class) balanced samples and the label orders are each one
    pass for all entities.  Only fitting (on ≤ ``cap`` rows per class) and predicting (on that
    entity's repeated rows) are per entity, ``parallelism`` of them at a time.  Every repeated row, exact
    copies included, reaches the selector; ``train_nulls`` says what becomes of clean rows with a null
    feature (see :func:`training_rows`).
    """
    ks = _keys(key)
    # one grouped pass gives the repeated (key, entity) pairs, kept as one row per key
    reps = duplicate_counts(df, ks, entity)
    listed = reps.filter(F.col(entity).isin(list(entities)))
    by_key = listed.groupBy(*ks).agg(F.collect_set(entity).alias("_repeated"))  # at most the listed entities
    # one join tells clean rows (no entity repeats the key) from repeated ones
    tagged = keyed_join(df, by_key, ks, "left")
    clean = tagged.filter(F.col("_repeated").isNull() & F.col(entity).isin(list(entities))).select(*df.columns)
    clean = training_rows(clean, inputs, train_nulls)
    repeated = tagged.filter(F.array_contains("_repeated", F.col(entity))).select(*df.columns)
    if fill_features is not None:
        repeated = repeated.na.fill(fill_features, subset=inputs)
    labels = label_orders(clean, entity, label_col)
    samples = balanced_sample(clean, label_col, cap, [row_id], seed, by=[entity])
    samples = stable_layout(samples, [entity, row_id], partitions).persist(StorageLevel.MEMORY_AND_DISK)
    repeated = repeated.persist(StorageLevel.MEMORY_AND_DISK)

    def one(value):
        if value not in labels:
            return None
        mine = stable_layout(samples.filter(F.col(entity) == value), [row_id], partitions)
        model = _fit_from_sample(mine, labels[value], inputs, label_col, classifier, seed)
        return model.transform(repeated.filter(F.col(entity) == value)).select(*df.columns, "predictedLabel")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(entities)))) as pool:
        parts = [p for p in pool.map(one, entities) if p is not None]
    if not parts:  # no entity has a labelled clean row: nothing can be predicted, nothing is resolved
        parts = [repeated.select(*df.columns, F.lit(None).cast("string").alias("predictedLabel"))]
    # model output is read by both sides of the selector (aggregates and join back): compute it once
    preds = reduce(lambda a, b: a.unionByName(b), parts).persist(StorageLevel.MEMORY_AND_DISK)
    selected = select_predicted(preds, ks, label_col, id_col, "predictedLabel", id_map, row_id,
                                entity=entity, rule=rule)
    # write the flagged rows once to the shared folder: the merge reads them twice, a lost executor
    # does not send the models back to work, and the cached inputs can go
    selected = cut_lineage(selected)
    for cached in (preds, repeated, samples):
        cached.unpersist()
    kept = selected.filter(F.col("select_flag") == 1).select(*df.columns)
    merged = merge_resolved(df, kept, ks, entity, repeated=reps)
    return selected, merged


def wide_weather(merged: DataFrame, key, entity: str, entities: list[str],
                 measures: list[str] | None = None, dictionaries: dict[str, list[str]] | None = None) -> DataFrame:
    return to_wide(merged, key, entity, entities, measures, dictionaries=dictionaries)


__all__ = ["NoClassModel", "training_rows", "make_classifier", "clean_rows", "repeated_rows", "fit_class_model", "class_sample", "predict_duplicates",
           "train_and_evaluate_classifier", "label_orders", "resolve_duplicates", "wide_weather"]
