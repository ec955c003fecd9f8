"""Parameter search: tuning split, grids, scoring of configurations, and the held-out comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from . import matching
from .quantiles import counted

#: Fixed values of the search.
SEED, TUNING_SHARE, LEAST_IMAGES = 42, 0.6, 4
_BETWEEN = "\x1f"


def first_images(images: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """The first so many images in order; all where no number is given."""
    return images if most is None else images.orderBy(order).limit(most)


def tuning_split(images: DataFrame, key: str = "image_id", most: int | None = None, share: float = TUNING_SHARE, seed: int = SEED) -> DataFrame:
    """(key, position, split): ``tuning`` or ``validation`` for each distinct id; NULL is none.

    Positions follow a seeded hash of the ids, ranked by ranges: no id comes to the driver, only how many there are.
    """
    ids = images.where(F.col(key).isNotNull()).select(F.struct(F.xxhash64(key, F.lit(seed)), F.col(key).alias("id")).alias("__h")).distinct()
    placed = counted(ids, "__h").select(F.col("__h.id").alias(key), F.col("below").cast("int").alias("position"))
    total = ids.count()
    total = total if most is None else min(total, most)
    if total < LEAST_IMAGES:
        raise ValueError(f"at least {LEAST_IMAGES} annotated images are needed")
    n = min(max(int(round(total * share)), 1), total - 1)
    return placed.where(F.col("position") < total).withColumn("split", F.when(F.col("position") < n, "tuning").otherwise("validation"))


def grid(spark: SparkSession, diameters: list[int | None], cellprobs: list[float], flows: list[float], min_sizes: list[int]) -> DataFrame:
    """Every combination of the parameters as a configuration with its id; None is the native diameter."""
    out = spark.range(0, 1, 1, 1)  # parameters: a dozen rows, in one partition
    for name, kind, values in (("diameter", "int", diameters), ("cellprob_threshold", "double", cellprobs), ("flow_threshold", "double", flows), ("min_size", "int", min_sizes)):
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v).cast(kind) for v in values))))
    out = out.drop("id")
    return out.select(E.config_id(F.col("diameter"), F.col("cellprob_threshold"), F.col("flow_threshold"), F.col("min_size")).alias("config_id"), "*")


def score_configurations(images: DataFrame, truth: DataFrame, configs: DataFrame, segmenter) -> tuple[DataFrame, DataFrame]:
    """(scores of every image under every configuration, totals of each configuration).

    ``truth`` is the painted annotation (image, row, col, label).  Images without
    cells, true or predicted, count too.
    """
    ids = [r[0] for r in configs.select("config_id").collect()]  # at most matching.MOST_CONFIGS
    each = lambda df: df.withColumn("config_id", F.explode(F.lit(ids)))
    at = ["config_id", "image", "row", "col"]
    pred = matching.segment(images, configs, segmenter).select(*at, F.col("label").alias("pred_label"))
    gt = each(truth.join(images.select("image"), "image", "left_semi")).select(*at, F.col("label").alias("gt_label"))
    pairs = gt.join(pred, at, "full").select(F.concat_ws(_BETWEEN, "config_id", "image").alias("image"), F.coalesce("gt_label", F.lit(0)).alias("gt_label"), F.coalesce("pred_label", F.lit(0)).alias("pred_label"))
    n = lambda c: F.countDistinct(F.when(F.col(c) > 0, F.col(c)))
    found = pairs.groupBy("image").agg(n("gt_label").alias("n_gt"), n("pred_label").alias("n_pred"))
    every = each(images.select("image")).select(F.concat_ws(_BETWEEN, "config_id", "image").alias("image"))
    counts = every.join(found, "image", "left").na.fill(0, ["n_gt", "n_pred"])
    scores = matching.match_metrics(matching.assign(matching.overlaps(pairs)), counts)
    parts = F.split("image", _BETWEEN)
    scores = scores.select(F.get(parts, 0).alias("config_id"), F.get(parts, 1).alias("name"), "*").drop("image").withColumnRenamed("name", "image")
    return scores, configs.join(matching.micro_summary(scores, "config_id"), "config_id")


def two_stage_search(spark: SparkSession, score: Callable[[DataFrame], DataFrame], baseline: dict, cellprobs: list[float], flows: list[float], diameters: list[int | None]) -> tuple[DataFrame, Row]:
    """(totals of all configurations, the best): thresholds at the baseline's diameter first, then diameters at the best thresholds.

    ``score`` gives the totals of configurations, as ``score_configurations`` does.  The
    best is chosen among both stages; of equals the first in order of stage, then id.
    """
    first = score(grid(spark, [baseline["diameter"]], cellprobs, flows, [baseline["min_size"]])).withColumn("stage", F.lit(1))
    best = matching.select_best(first, "config_id").first()
    second = score(grid(spark, diameters, [best["cellprob_threshold"]], [best["flow_threshold"]], [baseline["min_size"]])).withColumn("stage", F.lit(2))
    every = first.unionByName(second)
    order = every.withColumn("__order", F.concat_ws(_BETWEEN, F.col("stage").cast("string"), "config_id"))
    return every, matching.select_best(order, "__order").drop("__order").first()


def held_out_comparison(baseline: DataFrame, selected: DataFrame) -> DataFrame:
    """The totals of both configurations on held-out images, and whether the selected one improved, tied, or did_not_generalise."""
    both = baseline.withColumn("split", F.lit("validation_baseline")).unionByName(selected.withColumn("split", F.lit("validation_optimized")))
    f1 = lambda name: F.max(F.when(F.col("split") == name, F.col("f1")))
    told = both.agg(f1("validation_baseline").alias("__a"), f1("validation_optimized").alias("__b"))
    verdict = F.when(F.col("__b") > F.col("__a"), "improved").when(F.col("__b") == F.col("__a"), "tied").otherwise("did_not_generalise")
    return both.crossJoin(F.broadcast(told)).withColumn("verdict", verdict).drop("__a", "__b")  # one row


def hardest_image(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.asc_nulls_last("f1"), "image").limit(1)
