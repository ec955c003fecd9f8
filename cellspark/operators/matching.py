"""Matching annotated objects with predicted ones: overlaps, IoU, assignment, scores.

Labels come as rows (image, row, col, label); 0 is background.  Everything is sparse:
pairs that do not overlap have no row and IoU 0.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .components import components
from .quantiles import quantiles
from .tables import written


def paint(pixels: DataFrame) -> DataFrame:
    """One label a pixel: where annotations overlap the last (highest) label wins."""
    return pixels.groupBy("image", "row", "col").agg(F.max("label").alias("label"))


def areas(pixels: DataFrame, label: str = "label") -> DataFrame:
    return pixels.where(F.col(label) > 0).groupBy("image", label).agg(F.count("*").alias("area"))


def overlaps(pairs: DataFrame) -> DataFrame:
    """(image, gt_label, pred_label, n, gt_area, pred_area, iou) of pixels that hold both labels.

    One pass: the contingency table is small beside the pixels, and areas are sums
    over it.
    """
    n = pairs.groupBy("image", "gt_label", "pred_label").agg(F.count("*").alias("n"))
    gt, pred = Window.partitionBy("image", "gt_label"), Window.partitionBy("image", "pred_label")
    n = n.withColumns({"gt_area": F.sum("n").over(gt), "pred_area": F.sum("n").over(pred)})
    return n.where("gt_label > 0 and pred_label > 0").withColumn("iou", E.iou(F.col("n"), F.col("gt_area"), F.col("pred_area")))


def best_match(ious: DataFrame, labels: DataFrame, side: str, other: str) -> DataFrame:
    """For every label of ``side`` the best of the other side: highest IoU, lowest label.

    Many to one.  A label that overlaps nothing gets label 1 with IoU 0, as an argmax
    over a row of zeros does.
    """
    best = ious.groupBy("image", side).agg(F.max(F.struct("iou", (-F.col(other)).alias("low"))).alias("b"))
    out = labels.select("image", side).distinct().join(best, ["image", side], "left")
    return out.select("image", side, F.coalesce(-F.col("b.low"), F.lit(1)).alias(f"best_{other}"), F.coalesce("b.iou", F.lit(0.0)).alias("best_iou")).withColumn("matched", F.col("best_iou") >= E.IOU_THRESHOLD)


def failures(best: DataFrame) -> DataFrame:
    """Labels whose best match stays under the threshold."""
    return best.where(F.col("best_iou") < E.IOU_THRESHOLD)


def with_best_match(cells: DataFrame, best: DataFrame, label: str = "label", side: str = "gt_label") -> DataFrame:
    """Cells with their best match, by label; 0 and IoU 0 for a cell that was painted over and so has none.

    ``segmentation_success`` is ``matched`` as a number.
    """
    found = best.withColumnRenamed(side, label)
    other = next(c for c in best.columns if c.startswith("best_") and c != "best_iou")
    out = cells.join(found, ["image", label], "left").withColumns({other: F.coalesce(other, F.lit(0)), "best_iou": F.coalesce("best_iou", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(False))})
    return out.withColumn("segmentation_success", F.col("matched").cast("int"))


def iou_summary(matches: DataFrame, iou: str = "iou") -> DataFrame:
    """Mean and median IoU over all rows given: matched ones only, or all cells with 0 for the unmatched."""
    q = quantiles(matches, iou, [0.5]).select(F.get("q", 0).alias("median_iou"))
    return matches.agg(F.count(iou).alias("objects"), F.avg(iou).alias("mean_iou")).crossJoin(F.broadcast(q))  # one row


def sparse_assignment(edges: list[list[tuple[int, float]]]) -> list[int | None]:
    """For each row the column that it gets, or None, so that the summed cost is least and no column is given twice.

    ``edges`` has (column, cost) of each row; a row without a column costs nothing.
    Shortest augmenting paths over the edges that are there: no matrix is built.
    """
    u, v = [0.0] * len(edges), defaultdict(float)
    row_of: dict[int, int] = {}
    got: list[int | None] = [None] * len(edges)
    for start in range(len(edges)):
        own = lambda i: [*edges[i], (-1 - i, 0.0)]  # noqa: E731  a column of the row's own stands for none
        u[start] = min(c - v[j] for j, c in own(start))
        dist: dict[int, float] = {}
        before: dict[int, int] = {}
        done: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        i, so_far = start, 0.0
        while True:
            for j, c in own(i):
                d = so_far + c - u[i] - v[j]
                if j not in done and d < dist.get(j, np.inf):
                    dist[j], before[j] = d, i
                    heapq.heappush(heap, (d, j))
            so_far, j = heapq.heappop(heap)
            while j in done:
                so_far, j = heapq.heappop(heap)
            done[j] = so_far
            if j not in row_of:
                break
            i = row_of[j]
        for k, d in done.items():
            v[k] += d - so_far
            if k in row_of:
                u[row_of[k]] += so_far - d
        u[start] += so_far
        while True:
            i = before[j]
            row_of[j], got[i], j = i, j, got[i]
            if i == start:
                break
    return [j if j is not None and j >= 0 else None for j in got]


def assign(ious: DataFrame, keys: tuple[str, ...] = ("image",)) -> DataFrame:
    """The one-to-one assignment of each image that maximises total IoU.

    Pairs without overlap are no pairs.  A pair that outweighs the best others of both its labels together
    stands in every best assignment (to give it up frees these two at most), so such pairs are settled first, by
    rounds that settle half of the labels or more.  What is left falls into labels that overlap, directly or through others;
    each such part is a group of its own, so an image of many labels is many tasks' work.
    """
    label = lambda c: F.col(c).cast("long").alias(c)
    pairs = written(ious.where("iou > 0").select(*keys, label("gt_label"), label("pred_label"), "iou"))
    settled = pairs.where("false")
    left = pairs.count()
    while left:
        sure = written(_sure(pairs, keys))
        rest = pairs
        for side in ("gt_label", "pred_label"):
            own = F.struct(*keys, side).alias("own")  # NULL keys are a key
            rest = rest.withColumn("own", own).join(sure.select(own).hint("merge"), "own", "left_anti").drop("own")
        settled, pairs, before = settled.unionByName(sure), written(rest), left
        left = pairs.count()
        if 2 * left > before:
            break
    settled = settled.withColumn("matched", F.col("iou") >= E.IOU_THRESHOLD)
    if not left:
        return settled
    node = lambda side, c: F.struct(*keys, F.lit(side).alias("side"), F.col(c).alias("label"))
    parts = components(pairs.select(node(0, "gt_label").alias("a"), node(1, "pred_label").alias("b")))
    held = pairs.withColumn("id", node(0, "gt_label")).join(parts.hint("merge"), "id").drop("id")
    schema = ", ".join(f"`{k}` {dict(ious.dtypes)[k]}" for k in keys) + ", gt_label long, pred_label long, iou double, matched boolean"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        gt, i = np.unique(rows.gt_label, return_inverse=True)
        pred, j = np.unique(rows.pred_label, return_inverse=True)
        edges: list[list[tuple[int, float]]] = [[] for _ in gt]
        for a, b, c in zip(i.tolist(), j.tolist(), rows.iou.tolist(), strict=True):
            edges[a].append((b, -c))
        value = {(a, b): -c for a, e in enumerate(edges) for b, c in e}
        found = [(gt[a], pred[b], value[a, b]) for a, b in enumerate(sparse_assignment(edges)) if b is not None]
        out = pd.DataFrame(found, columns=["gt_label", "pred_label", "iou"])
        for k in reversed(keys):
            out.insert(0, k, rows[k].iloc[0])
        return out.assign(matched=out.iou >= E.IOU_THRESHOLD)

    return settled.unionByName(held.groupBy("component").applyInPandas(lambda rows: solve(rows), schema))


def _sure(pairs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pairs whose IoU is above the sum of the next best of both labels."""
    out, own = pairs, F.col("iou")
    for side in ("gt_label", "pred_label"):
        w = Window.partitionBy(*keys, side).orderBy(F.desc("iou"))
        out = out.withColumns({f"__turn_{side}": F.row_number().over(w), f"__next_{side}": F.coalesce(F.lead("iou").over(w), F.lit(0.0))})
    best = (F.col("__turn_gt_label") == 1) & (F.col("__turn_pred_label") == 1)
    return out.where(best & (own > F.col("__next_gt_label") + F.col("__next_pred_label"))).select(pairs.columns)


def match_metrics(matches: DataFrame, counts: DataFrame, threshold: float = E.IOU_THRESHOLD) -> DataFrame:
    """TP, FP, FN and scores of each image of ``counts`` (image, n_gt, n_pred), matches or not."""
    hit = F.col("iou") >= threshold
    m = matches.groupBy("image").agg(F.count_if(hit).alias("true_positives"), F.sum(F.when(hit, F.col("iou"))).alias("matched_iou_sum"), F.avg(F.when(hit, F.col("iou"))).alias("mean_matched_iou"))
    out = counts.join(m, "image", "left").withColumn("true_positives", F.coalesce("true_positives", F.lit(0)))
    out = out.withColumns({"false_positives": F.col("n_pred") - F.col("true_positives"), "false_negatives": F.col("n_gt") - F.col("true_positives"), "matched_iou_sum": F.coalesce("matched_iou_sum", F.lit(0.0))})
    p, r, f = E.scores(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives"))
    return out.withColumns({"precision": p, "recall": r, "f1": f})


def micro_summary(images: DataFrame, *keys: str) -> DataFrame:
    """Totals over images, then scores; the mean IoU is weighted by matches."""
    out = images.groupBy(*keys).agg(F.count("*").alias("images"), *(F.sum(c).alias(c) for c in ("true_positives", "false_positives", "false_negatives", "matched_iou_sum")))
    p, r, f = E.scores(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives"))
    return out.withColumns({"precision": p, "recall": r, "f1": f, "mean_matched_iou": F.try_divide("matched_iou_sum", "true_positives")}).drop("matched_iou_sum")


def line_evaluation(images: DataFrame, key: str = "cell_line") -> DataFrame:
    """Micro scores of each line; its mean IoU is the plain mean of image means."""
    out = images.groupBy(key).agg(F.countDistinct("image").alias("evaluation_images"), *(F.sum(c).alias(f"micro_{c}") for c in ("true_positives", "false_positives", "false_negatives")), F.avg("mean_matched_iou").alias("mean_matched_iou"))
    p, r, f = E.scores(F.col("micro_true_positives"), F.col("micro_false_positives"), F.col("micro_false_negatives"))
    return out.withColumns({"precision": p, "recall": r, "f1": f})


def select_best(summary: DataFrame, order: str) -> DataFrame:
    """The best configuration: F1, then IoU, then recall, then the first by ``order``."""
    return summary.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("mean_matched_iou"), F.desc_nulls_last("recall"), F.asc(order)).limit(1)


#: A grid of more configurations than this is refused: each is run on every image.
MOST_CONFIGS = 1000


def segment(images: DataFrame, configs: DataFrame, segmenter, schema: str = "image string, config_id string, row int, col int, label long") -> DataFrame:
    """Predicted pixels of every image under every configuration.

    ``segmenter()`` makes, once a task, a function (image row, config row) -> label
    array; no model comes with this library.
    """
    few = configs.limit(MOST_CONFIGS + 1).collect()  # a grid of a dozen configurations
    if len(few) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} configurations")
    grid = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in configs.schema)) for r in few))
    pairs = images.withColumn("__c", F.explode(grid)).select(*images.columns, "__c.*") if few else images.crossJoin(configs)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = segmenter()
        for batch in batches:
            for item in batch.to_dict("records"):
                labels = run(item)
                r, c = np.nonzero(labels)
                yield pd.DataFrame({"image": item["image"], "config_id": item["config_id"], "row": r, "col": c, "label": labels[r, c]})

    return pairs.mapInPandas(task, schema)
