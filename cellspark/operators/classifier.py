"""Classifier of cell lines: groups, folds without leaks, out-of-fold tables, and the final fit."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import stats
from .quantiles import column_quantiles
from .tables import written

#: Training cells of a class at most, folds, seed, iterations, trees and the cells of a leaf.
MOST_CELLS, FOLDS, SEED, ITERATIONS, TREES, LEAF = 5000, 5, 42, 2000, 300, 5
#: Balanced training cells that a task holds.
ROWS_A_TASK = 5000
METRICS = ("accuracy", "balanced_accuracy", "macro_f1")


def _groups_of_class(cells: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in cells.groupBy(label).agg(F.countDistinct("split_group")).collect()}  # a row a class


def split_groups(cells: DataFrame, label: str = "cell_line") -> tuple[DataFrame, str, dict]:
    """(cells with split_group, strategy, groups of each class).

    Fields of view (line, well, location) where all cells have them and each class two or
    more; else images; an error where a class has fewer than two of these as well.
    """
    if {"well", "location"} <= set(cells.columns) and not cells.where("well is null or location is null").limit(1).count():
        out = cells.withColumn("split_group", E.group_key(label, "well", "location"))
        found = _groups_of_class(out, label)
        if found and min(found.values()) >= 2:
            return out, "cell_line + well + location", found
    out = cells.withColumn("split_group", E.group_key(label, "image"))
    found = _groups_of_class(out, label)
    if not found or min(found.values()) < 2:
        raise ValueError(f"at least two groups of each class are needed: {found}")
    return out, "cell_line + image", found


def scaler(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """Robust scaling with the medians and quartile ranges of the training rows alone."""
    q = column_quantiles(train, columns, [0.25, 0.5, 0.75]).first()
    terms = ", ".join(f"(`{c}` - {q[c][1]!r}D) / {(q[c][2] - q[c][0]) or 1.0!r}D AS `{c}_scaled`" for c in columns)
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def weighted(train: DataFrame, label: str) -> DataFrame:
    """Rows weighed so that all classes weigh the same."""
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # a row a class
    total = sum(n.values())
    each = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, total / (len(n) * v))))
    return train.withColumn("__weight", F.element_at(each, F.col(label)))


def fit(train: DataFrame, columns: list[str], label: str, classes: list[str], name: str, seed: int, trees: int = TREES) -> PipelineModel:
    """``logistic_regression`` on scaled columns, or ``random_forest`` on the columns as they are.  Classes are numbered in the order given."""
    index = StringIndexerModel.from_labels(classes, inputCol=label, outputCol="__y", handleInvalid="error")
    if name == "logistic_regression":
        n = max(train.count(), 1)
        inputs, before = [f"{c}_scaled" for c in columns], [scaler(train, columns)]
        model = LogisticRegression(labelCol="__y", featuresCol="__x", family="multinomial", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=ITERATIONS)
    elif name == "random_forest":
        inputs, before, train = columns, [], weighted(train, label)
        model = RandomForestClassifier(labelCol="__y", featuresCol="__x", weightCol="__weight", numTrees=trees, minInstancesPerNode=LEAF, featureSubsetStrategy="sqrt", maxDepth=30, maxBins=256, seed=seed)
    else:
        raise ValueError(f"unknown model {name}")
    steps = [index, *before, VectorAssembler(inputCols=inputs, outputCol="__x"), model]
    return Pipeline(stages=steps).fit(train)


def predict(model: PipelineModel, cells: DataFrame, label: str, classes: list[str]) -> DataFrame:
    """``cells`` with predicted_cell_line, correct, and probability_<class> for every class, 0 for one the model doesn't know."""
    known = [x for s in model.stages if isinstance(s, StringIndexerModel) for x in s.labels]
    got = model.transform(cells).withColumn("__p", vector_to_array("probability"))
    share = lambda c: F.coalesce(F.get("__p", known.index(c)), F.lit(0.0)) if c in known else F.lit(0.0)
    got = got.withColumn("predicted_cell_line", F.get(F.lit(known), F.col("prediction").cast("int")))
    return got.select(*cells.columns, "predicted_cell_line", F.col(label).eqNullSafe(F.col("predicted_cell_line")).alias("correct"), *(share(c).alias(f"probability_{c}") for c in classes))


@dataclass
class Validation:
    """The tables of a cross-validation, a part for each fold and model."""

    fold_metrics: DataFrame
    class_metrics: DataFrame
    predictions: DataFrame
    importances: DataFrame
    training: DataFrame


def training_record(train: DataFrame, test: DataFrame, label: str, balanced: int, fold: int) -> DataFrame:
    """(fold, class, available and balanced training cells, held-out cells and groups) of each class."""
    a = train.groupBy(label).agg(F.count("*").alias("available_training_cells"))
    b = test.groupBy(label).agg(F.count("*").alias("held_out_cells"), F.countDistinct("split_group").alias("held_out_groups"))
    out = a.join(b, label, "full").na.fill(0)
    return out.select(F.lit(fold).alias("fold"), label, "available_training_cells", F.lit(balanced).cast("long").alias("balanced_training_cells"), "held_out_cells", "held_out_groups")


def cross_validate(cells: DataFrame, columns: list[str], label: str, ids: list[str], folds: int = FOLDS, models: Iterable[str] = ("logistic_regression", "random_forest"), most: int = MOST_CELLS, seed: int = SEED, trees: int = TREES) -> Validation:
    """Grouped cross-validation of ``cells`` (with split_group; ``ids`` name a row).

    Scaling, balancing and fitting see a fold's training rows only.  No more folds than
    the class with the fewest groups has groups.  A group on both sides, or a
    class without training rows, is an error.
    """
    spark = cells.sparkSession
    cells = cells.where(E.finite(*columns))
    found = _groups_of_class(cells, label)
    classes, folds = sorted(found), min(folds, min(found.values()))
    if folds < 2:
        raise ValueError(f"at least two groups of each class are needed: {found}")
    # written, the folds' size is known, and a few groups' are broadcast; rows are then dealt by their ids, so that a large group is many tasks' work
    data = written(cells.join(written(stats.group_folds(cells, "split_group", label, folds, seed)), "split_group").repartition(*ids))
    if not data.groupBy("split_group").agg(F.min("fold").alias("a"), F.max("fold").alias("b")).where("a <> b").isEmpty():
        raise RuntimeError("a group stands in both training and test data")
    sizes = {r[0]: (r[1], r[2]) for r in data.groupBy("fold").agg(F.count("*"), F.countDistinct("split_group")).collect()}  # a row a fold
    parts = -(-most * len(classes) // ROWS_A_TASK)
    metrics, importances, per_class, predictions, records = [], [], [], [], []
    for fold in range(1, folds + 1):
        train, test = data.where(F.col("fold") != fold - 1).drop("fold"), data.where(F.col("fold") == fold - 1).drop("fold")
        sample = stats.balanced_sample(train, label, most, seed + fold, *ids, classes=classes)
        balanced = sample.repartition(parts, *ids).sortWithinPartitions(*ids).persist()
        n = balanced.count()
        held, groups = sizes.get(fold - 1, (0, 0))
        records.append(training_record(train, test, label, n // len(classes), fold))
        for name in models:
            model = fit(balanced, columns, label, classes, name, seed + fold, trees)
            got = predict(model, test, label, classes).select(F.lit(fold).alias("fold"), F.lit(name).alias("model"), "*")
            counts = written(stats.label_counts(got, label, "predicted_cell_line"))  # predicted once for all metrics
            each = stats.metrics_of_counts(counts, label, "predicted_cell_line")
            m = stats.overall_metrics(each, counts, label, "predicted_cell_line", F.col("n")).first()
            metrics.append((fold, name, n, held, groups, *(m[x] for x in METRICS)))
            per_class.append(each.select(F.lit(fold).alias("fold"), F.lit(name).alias("model"), "*"))
            predictions.append(got)
            if name == "random_forest":
                importances += [(fold, c, float(x)) for c, x in zip(columns, model.stages[-1].featureImportances, strict=True)]
        balanced.unpersist()

    def together(parts):
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    return Validation(
        spark.createDataFrame(metrics, "fold int, model string, training_cells long, held_out_cells long, held_out_groups long, accuracy double, balanced_accuracy double, macro_f1 double"),
        together(per_class), together(predictions), spark.createDataFrame(importances, "fold int, feature string, importance double"), together(records),
    )


def model_summary(fold_metrics: DataFrame) -> DataFrame:
    """(model, accuracy_mean, accuracy_std, ...): mean and sample standard deviation over folds."""
    return fold_metrics.groupBy("model").agg(*(f(m).alias(f"{m}_{n}") for m in METRICS for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))))


def best_model(summary: DataFrame) -> DataFrame:
    """The model of the highest mean macro F1; of equals the first by name."""
    return summary.orderBy(F.desc_nulls_last("macro_f1_mean"), "model").limit(1)


def importance_summary(importances: DataFrame) -> DataFrame:
    """(feature, mean_importance, std_importance), the most important first."""
    out = importances.groupBy("feature").agg(F.avg("importance").alias("mean_importance"), F.stddev_samp("importance").alias("std_importance"))
    return out.orderBy(F.desc("mean_importance"), "feature")


def pooled_metrics(predictions: DataFrame, model: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(metrics of each class, overall metrics) over all out-of-fold predictions of a model."""
    own = predictions.where(F.col("model") == model)
    each = stats.class_metrics(own, label, "predicted_cell_line")
    return each, stats.overall_metrics(each, own, label, "predicted_cell_line")


def final_fit(cells: DataFrame, columns: list[str], label: str, ids: list[str], name: str, most: int = MOST_CELLS, seed: int = SEED, trees: int = TREES) -> tuple[PipelineModel, DataFrame]:
    """(model, training cells): the chosen model on a balanced sample of all cells."""
    cells = cells.where(E.finite(*columns))
    classes = sorted(r[0] for r in cells.select(label).distinct().collect())  # a row a class
    train = stats.balanced_sample(cells, label, most, seed, *ids, classes=classes)
    return fit(train, columns, label, classes, name, seed, trees), train.select(*ids, "split_group", label)
