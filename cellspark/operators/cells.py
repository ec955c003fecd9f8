"""Per-cell tables: region properties, crowding, quality flags, summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .quantiles import medians as exact_medians
from .quantiles import quantiles
from .tables import join_on, written

FEATURES = ("log_area", "eccentricity", "solidity", "log_aspect_ratio", "log_neighbours_within_50px", "log_nearest_neighbour_distance")


def moments(pixels: DataFrame) -> DataFrame:
    """Region properties that are plain aggregates, of (image, label, row, col, intensity).

    Partial aggregation keeps the shuffle at one row for each region and task.
    """
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    m = pixels.where("label > 0").groupBy("image", "label").agg(
        F.count("*").cast("double").alias("area"), F.min("row").alias("bbox_min_row"), F.min("col").alias("bbox_min_col"), (F.max("row") + 1).alias("bbox_max_row"), (F.max("col") + 1).alias("bbox_max_col"),
        F.avg(r).alias("centroid_row"), F.avg(c).alias("centroid_col"), F.var_pop(r).alias("vr"), F.var_pop(c).alias("vc"), F.covar_pop(r, c).alias("vrc"),
        F.avg("intensity").alias("intensity_mean"), F.median("intensity").alias("intensity_median"), F.stddev_pop("intensity").alias("intensity_std"), F.min("intensity").cast("double").alias("intensity_min"), F.max("intensity").cast("double").alias("intensity_max"),
    )
    # a pixel is a unit square: each adds 1/12 to the second moments
    vr, vc = F.col("vr") + 1 / 12, F.col("vc") + 1 / 12
    half, spread = (vr + vc) / 2, F.sqrt(F.pow((vr - vc) / 2, 2) + F.pow("vrc", 2))
    l1, l2 = half + spread, F.greatest(half - spread, F.lit(0.0))
    return m.withColumns({
        "extent": F.col("area") / ((F.col("bbox_max_row") - F.col("bbox_min_row")) * (F.col("bbox_max_col") - F.col("bbox_min_col"))),
        "equivalent_diameter_area": F.sqrt(4 * F.col("area") / F.pi()), "major_axis_length": 4 * F.sqrt(l1), "minor_axis_length": 4 * F.sqrt(l2),
        "eccentricity": F.sqrt(1 - F.try_divide(l2, l1)), 
        # equal spreads have no direction but that of the covariance; the sign of zero is none
        "orientation": F.when(F.abs(vr - vc) < 1e-9, F.when(F.col("vrc") > 1e-9, F.pi() / 4).otherwise(-F.pi() / 4)).otherwise(0.5 * F.atan2(F.when(F.abs("vrc") < 1e-9, 0.0).otherwise(2 * F.col("vrc")), vr - vc)),
    }).drop("vr", "vc", "vrc")


def hull_area(rows: np.ndarray, cols: np.ndarray) -> int:
    """Pixels in the convex hull: those whose centre lies in or on the hull of all points half a pixel beside the pixels' centres.

    Coordinates are doubled, so everything is whole numbers.
    """
    r, c = 2 * rows.astype(np.int64), 2 * cols.astype(np.int64)
    points = np.unique(np.concatenate([np.stack((r + a, c + b), 1) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))]), axis=0).tolist()

    def chain(p):
        out: list[list[int]] = []
        for x in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (x[1] - out[-1][1]) <= (out[-1][1] - out[-2][1]) * (x[0] - out[-1][0]):
                out.pop()
            out.append(x)
        return out[:-1]

    hull = np.array(chain(points) + chain(points[::-1]))
    y, x = np.meshgrid(np.arange(r.min(), r.max() + 1, 2), np.arange(c.min(), c.max() + 1, 2), indexing="ij")
    inside = np.ones(y.shape, bool)
    for (y1, x1), (y2, x2) in zip(hull, np.roll(hull, -1, 0), strict=True):
        inside &= (y2 - y1) * (x - x1) >= (x2 - x1) * (y - y1)
    return int(inside.sum())


def _hull_ends(region: np.ndarray, y: np.ndarray, x: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each line ``at`` of region ``of`` the greatest whole x/2 in the convex hull of the region's points.

    Points are sorted by region and y, one for each y.  All regions' hulls grow together, a point of each at a time.
    """
    n = np.bincount(region)
    start = np.cumsum(n) - n
    hx, hy, depth = np.empty_like(x), np.empty_like(y), np.zeros(len(n), np.int64)  # a stack for each region, in its points' places
    alive = np.arange(len(n))
    for k in range(int(n.max())):
        alive = alive[n[alive] > k]
        new = start[alive] + k
        todo = np.arange(len(alive))
        while len(todo := todo[depth[alive[todo]] > 1]):
            r, p = alive[todo], new[todo]
            b = start[r] + depth[r] - 1
            inner = (hx[b] - hx[b - 1]) * (y[p] - hy[b]) <= (x[p] - hx[b]) * (hy[b] - hy[b - 1])
            todo = todo[inner]
            depth[alive[todo]] -= 1
        top = start[alive] + depth[alive]
        hx[top], hy[top] = x[new], y[new]
        depth[alive] += 1
    kept = np.arange(len(x)) - start[region] < depth[region]
    hx, hy, own = hx[kept], hy[kept], region[kept]
    low, span = int(hy.min()), int(hy.max() - hy.min()) + 1
    b = np.searchsorted(own * span + hy - low, of * span + at - low)  # no line is a region's first, so a corner lies before
    a = b - 1
    return (hx[a] * (hy[b] - hy[a]) + (hx[b] - hx[a]) * (at - hy[a])) // (2 * (hy[b] - hy[a]))


def hull_areas(region: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """``hull_area`` of all regions 0, 1, ... at once; pixels are sorted by region and row."""
    n = int(region[-1]) + 1
    first = np.flatnonzero(np.r_[True, (np.diff(region) != 0) | (np.diff(row) != 0)])  # the first pixel of each line
    own, line = region[first], row[first]
    top, bottom = np.searchsorted(own, np.arange(n)), np.searchsorted(own, np.arange(n), "right") - 1
    high = line[bottom] - line[top] + 1
    of = np.repeat(np.arange(n), high)
    at = 2 * (np.arange(len(of)) - np.repeat(np.cumsum(high) - high, high) + line[top][of])
    ends = []
    for side in (np.maximum.reduceat(col, first), -np.minimum.reduceat(col, first)):
        # half a pixel above, beside and below the line's last pixel; of points on one line the outermost
        r, y = np.tile(own, 3), np.concatenate((2 * line - 1, 2 * line, 2 * line + 1))
        x = np.concatenate((2 * side, 2 * side + 1, 2 * side))
        order = np.lexsort((-x, y, r))
        r, y, x = r[order], y[order], x[order]
        one = np.r_[True, (np.diff(r) != 0) | (np.diff(y) != 0)]
        ends.append(_hull_ends(r[one], y[one], x[one], of, at))
    return np.bincount(of, ends[0] + ends[1] + 1, n)


#: Pixels whose regions one call measures.
BATCH_PIXELS = 200_000
#: Length that a border pixel adds, by 1, 2 and 10 times its straight, own and diagonal border neighbours.
_BORDER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def _shift_sum(a: np.ndarray, steps) -> np.ndarray:
    p = np.pad(a.astype(np.int64), 1)
    return sum(p[1 + r : p.shape[0] - 1 + r, 1 + c : p.shape[1] - 1 + c] for r, c in steps)


def perimeter(mask: np.ndarray) -> float:
    """Length of the line through the centres of the border pixels."""
    straight, slant = ((0, 1), (0, -1), (1, 0), (-1, 0)), ((1, 1), (1, -1), (-1, 1), (-1, -1))
    m = np.pad(mask.astype(bool), 1)
    border = m & (_shift_sum(m, straight) < 4)
    code = border * (1 + 2 * _shift_sum(border, straight) + 10 * _shift_sum(border, slant))
    weight = np.zeros(51)
    for k, w in _BORDER.items():
        weight[k] = w
    return float(weight[np.minimum(code, 50)].sum())


def perimeter_crofton(mask: np.ndarray) -> float:
    """Perimeter from counts of crossings along four directions."""
    m = np.pad(mask.astype(np.int64), 1)
    h = np.abs(np.diff(m, axis=1)).sum()
    v = np.abs(np.diff(m, axis=0)).sum()
    d1 = np.abs(m[1:, 1:] - m[:-1, :-1]).sum()
    d2 = np.abs(m[1:, :-1] - m[:-1, 1:]).sum()
    return float(np.pi / 4 * ((h + v) / 2 + (d1 + d2) / (2 * 2**0.5)))


def region_batch(region: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the regions in order, perimeter, perimeter_crofton, solidity) of all regions of a batch of pixels at once.

    Neighbours are found by their keys among the sorted pixels of the batch: a key is a region and a place on one line.
    """
    names, own = np.unique(region, return_inverse=True)
    n = len(names)
    first_row, first_col = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first_row, own, row)
    np.minimum.at(first_col, own, col)
    r, c = row - first_row[own] + 1, col - first_col[own] + 1  # a frame of one pixel around each region
    wide = int(c.max()) + 2
    size = (int(r.max()) + 2) * wide
    keys = np.unique(own * size + r * wide + c)
    own = keys // size

    def held(at: np.ndarray, among: np.ndarray) -> np.ndarray:
        return among[np.minimum(np.searchsorted(among, at), len(among) - 1)] == at

    straight, slant = (1, -1, wide, -wide), (wide + 1, wide - 1, 1 - wide, -wide - 1)
    border = keys[sum(held(keys + s, keys).astype(int) for s in straight) < 4]
    code = 1 + 2 * sum(held(border + s, border).astype(int) for s in straight) + 10 * sum(held(border + s, border).astype(int) for s in slant)
    weight = np.zeros(51)
    for k, w in _BORDER.items():
        weight[k] = w
    perimeters = np.bincount(border // size, weight[np.minimum(code, 50)], n)
    # each direction is crossed where a pixel's neighbour on that line is missing, on either side
    crossed = lambda s: np.bincount(own, (~held(keys + s, keys)).astype(int) + (~held(keys - s, keys)).astype(int), n)
    crofton = np.pi / 4 * ((crossed(1) + crossed(wide)) / 2 + (crossed(wide + 1) + crossed(wide - 1)) / (2 * 2**0.5))
    area = np.bincount(own, minlength=n)
    place = keys % size
    return names, perimeters, crofton, area / hull_areas(own, place // wide, place % wide)


def outlines(pixels: DataFrame) -> DataFrame:
    """perimeter, perimeter_crofton and solidity of each region.

    Regions are dealt whole to partitions, and a task measures the regions of a partition in batches: a call of Python for many.
    """
    schema = "image string, label long, perimeter double, perimeter_crofton double, solidity double"
    inner = pixels.where("label > 0").select("image", "label", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))

    def measure(part: pd.DataFrame) -> pd.DataFrame:
        numbers, about = pd.factorize(pd.MultiIndex.from_frame(part[["image", "label"]]))
        names, *values = region_batch(numbers, part["row"].to_numpy(), part["col"].to_numpy())
        keys = about[names].to_frame(index=False, name=["image", "label"])
        return keys.assign(perimeter=values[0], perimeter_crofton=values[1], solidity=values[2])

    def task(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < BATCH_PIXELS:
                continue
            whole = pd.concat(held, ignore_index=True)
            last = whole[["image", "label"]].iloc[-1]  # its pixels may go on in the next batch
            open_ = (whole["image"] == last["image"]) & (whole["label"] == last["label"])
            held = [whole[open_]]
            if not open_.all():
                yield measure(whole[~open_])
        if held and len(whole := pd.concat(held, ignore_index=True)):
            yield measure(whole)

    return inner.repartition("image", "label").sortWithinPartitions("image", "label").mapInPandas(task, schema)


def cell_features(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """All properties and derived columns of every region; ``images`` has image, height, width.

    ``pixels`` holds every pixel, background included, for the image's own mean and spread.
    """
    about = pixels.groupBy("image").agg(F.avg("intensity").alias("image_intensity_mean"), F.stddev_pop("intensity").alias("image_intensity_std"))
    cells = moments(pixels).join(outlines(pixels), ["image", "label"]).withColumnRenamed("label", "cell_id").join(images, "image").join(about, "image")
    h, w = F.col("height"), F.col("width")
    cells = cells.withColumns({
        "aspect_ratio": E.aspect_ratio(F.col("major_axis_length"), F.col("minor_axis_length")), "circularity": E.circularity(F.col("area"), F.col("perimeter_crofton")),
        "centroid_to_edge_distance": E.edge_distance(F.col("centroid_row"), F.col("centroid_col"), h, w),
        "touches_image_border": E.touches_border(F.col("bbox_min_row"), F.col("bbox_min_col"), F.col("bbox_max_row"), F.col("bbox_max_col"), h, w),
        "cell_mean_intensity_zscore": E.z_score(F.col("intensity_mean"), F.col("image_intensity_mean"), F.col("image_intensity_std")),
    })
    return cells.join(crowding(cells, "image", "cell_id", "centroid_row", "centroid_col"), ["image", "cell_id"], "left")


def crowding(cells: DataFrame, image: str, cell: str, y: str, x: str, radius: float = E.NEIGHBOUR_RADIUS) -> DataFrame:
    """Neighbours within ``radius`` (inclusive) and the nearest neighbour's distance, NULL if alone.

    Neighbours are found through a grid of squares three times as wide as the radius: a cell asks those squares
    that it reaches, fewer than three on the average.  Cells with nobody there look on, over squares twice as wide each time,
    until they have found somebody.  A cell that is alone in its image, or has no place, has none.
    """
    p = cells.select(F.col(image).alias("i"), F.col(cell).alias("c"), F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    located = p.where(E.finite("y", "x"))
    near = written(_within(located, located, radius).groupBy("i", "c").agg(F.count("*").alias("n"), F.min("dist").alias("d")))
    several = located.groupBy("i").agg(F.count("*").alias("k")).where("k > 1").select("i")
    rest = written(located.join(near, ["i", "c"], "left_anti").join(several, "i", "left_semi"))
    far = None
    while not rest.isEmpty():
        radius *= 2
        found = written(_within(rest, located, radius).groupBy("i", "c").agg(F.min("dist").alias("d2")))
        far = found if far is None else far.unionByName(found)
        rest = written(rest.join(found, ["i", "c"], "left_anti"))
    out = p.select("i", "c").join(near, ["i", "c"], "left")
    out = out.join(far, ["i", "c"], "left") if far is not None else out.withColumn("d2", F.lit(None).cast("double"))
    return out.select(F.col("i").alias(image), F.col("c").alias(cell), F.coalesce("n", F.lit(0)).alias("neighbours_within_50px"), F.coalesce("d", "d2").alias("nearest_neighbour_distance"))


#: Width of a square, in radii.
SQUARE = 3


def _within(some: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """(i, c, dist) of each of ``some`` and each other cell of its image at most ``radius`` away; all have places."""
    line = lambda v: F.floor(v / (SQUARE * radius))
    # a little further, so that no neighbour at the very radius is rounded away
    reach = lambda c: radius + 1e-9 * (F.abs(F.col(c)) + radius)
    reached = lambda c: F.explode(F.sequence(line(F.col(c) - reach(c)), line(F.col(c) + reach(c))))
    seen = some.select("i", "c", "y", "x", reached("y").alias("gy")).withColumn("gx", reached("x"))
    there = others.select("i", line(F.col("y")).alias("gy"), line(F.col("x")).alias("gx"), F.col("c").alias("c2"), F.col("y").alias("y2"), F.col("x").alias("x2"))
    dist = F.sqrt(F.pow(F.col("y") - F.col("y2"), 2) + F.pow(F.col("x") - F.col("x2"), 2))
    return seen.join(there, ["i", "gy", "gx"]).where("c <> c2").select("i", "c", dist.alias("dist")).where(F.col("dist") <= radius)


def pixel_counts(pixels: DataFrame) -> DataFrame:
    """background_pixels, cell_pixels, cells and coverage of each image's label pixels (image, label)."""
    out = pixels.groupBy("image").agg(F.count_if(F.col("label") == 0).alias("background_pixels"), F.count_if(F.col("label") > 0).alias("cell_pixels"), F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("cells"))
    return out.withColumn("coverage", E.ratio(F.col("cell_pixels"), F.col("cell_pixels") + F.col("background_pixels")))


def relabel(pixels: DataFrame) -> DataFrame:
    """(image, label, dense_label): labels of each image numbered without gaps, in order; background stays out."""
    labels = pixels.where("label > 0").select("image", "label").distinct()
    return labels.withColumn("dense_label", F.row_number().over(Window.partitionBy("image").orderBy("label")))


#: Side of the square tiles in which crops look for their pixels.
TILE = 64


def crops(pixels: DataFrame, cells: DataFrame, padding: int = E.CROP_PADDING) -> DataFrame:
    """(image, cell_id, status, row_from ... col_to, pixels): the padded surroundings of each wanted cell.

    ``cells`` has image, cell_id, the bounding box, height and width; ``pixels`` image,
    row, col, label, intensity.  A crop's pixels are (row, col, intensity, target), in order;
    target tells the cell's own.  status: ok, label_not_found (no pixel of the cell), no_pixels.
    """
    box = E.crop_bounds(*(F.col(f"bbox_{x}") for x in ("min_row", "min_col", "max_row", "max_col")), F.col("height"), F.col("width"), padding)
    wanted = cells.select("image", "cell_id", box.alias("box")).select("image", "cell_id", "box.*")
    tile = lambda c: F.floor(F.col(c) / TILE)
    # a crop asks the tiles it touches, a pixel stands in one
    touched = lambda side: F.sequence(tile(f"{side}_from"), F.floor((F.col(f"{side}_to") - 1) / TILE))
    asked = wanted.where("row_to > row_from and col_to > col_from").withColumn("__ty", F.explode(touched("row"))).withColumn("__tx", F.explode(touched("col")))
    p = pixels.select("image", "row", "col", "intensity", F.col("label").alias("__label"), tile("row").alias("__ty"), tile("col").alias("__tx"))
    near = asked.join(p, ["image", "__ty", "__tx"]).where((F.col("row") >= F.col("row_from")) & (F.col("row") < F.col("row_to")) & (F.col("col") >= F.col("col_from")) & (F.col("col") < F.col("col_to")))
    own = F.col("__label") == F.col("cell_id")
    found = near.groupBy("image", "cell_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "intensity", own.alias("target")))).alias("pixels"), F.count_if(own).alias("__own"))
    out = wanted.join(found, ["image", "cell_id"], "left")
    return out.withColumn("status", F.when(F.col("pixels").isNull(), "no_pixels").when(F.col("__own") == 0, "label_not_found").otherwise("ok")).drop("__own")


def derived(cells: DataFrame) -> DataFrame:
    return cells.withColumns({
        "log_area": E.positive_log(F.col("area")), "log_aspect_ratio": E.positive_log(F.col("aspect_ratio")),
        "log_neighbours_within_50px": F.log1p("neighbours_within_50px"), "log_nearest_neighbour_distance": E.positive_log(F.col("nearest_neighbour_distance")),
    })


def area_limits(cells: DataFrame, value: str, low: float, high: float, *keys: str) -> DataFrame:
    """Exact quantiles of the finite values, one row for each key (or one row)."""
    q = quantiles(cells.where(E.finite(value)), value, [low, high], *keys)
    return q.select(*keys, F.get("q", 0).alias("area_qc_lower"), F.get("q", 1).alias("area_qc_upper"))


def qc_flags(cells: DataFrame, limits: DataFrame, value: str, features: list[str], border: Column, *keys: str) -> DataFrame:
    """Flags, include and the reasons.  Limits stay strict; a missing area is no extreme one.

    Limits are written first: their size is known then, and a few lines' are broadcast, so that no line's cells meet in one task.
    """
    limits = written(limits) if keys else limits
    joined = cells.join(limits, list(keys), "left") if keys else cells.crossJoin(F.broadcast(limits))  # one row
    extreme = F.coalesce((F.col(value) < F.col("area_qc_lower")) | (F.col(value) > F.col("area_qc_upper")), F.lit(False))
    out = joined.withColumns({"qc_touches_image_border": E.truthy(border), "qc_extreme_area": E.finite(value) & extreme, "qc_missing_feature": ~E.finite(*features)})
    flags = {"image_border": F.col("qc_touches_image_border"), "extreme_area": F.col("qc_extreme_area"), "missing_feature": F.col("qc_missing_feature")}
    return out.withColumns({"qc_include": ~(F.col("qc_touches_image_border") | F.col("qc_extreme_area") | F.col("qc_missing_feature")), "qc_exclusion_reason": E.reasons(**flags)})


def qc_accounting(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("*").alias("cells"), *(F.count_if(F.col(c)).alias(c) for c in ("qc_touches_image_border", "qc_extreme_area", "qc_missing_feature", "qc_include")))


def group_summary(cells: DataFrame, keys: list[str], medians: list[str] = [], means: list[str] = [], counts: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Size, medians, means and conditional counts of each group, of any size: a line, a cluster, an outcome."""
    out = cells.groupBy(*keys).agg(F.count("*").alias("cells"), *(F.avg(c).alias(f"mean_{c}") for c in means), *(F.count_if(c).alias(n) for n, c in counts.items()))
    if medians:
        out = join_on(out, exact_medians(cells, medians, *keys).withColumnsRenamed({c: f"median_{c}" for c in medians}), keys, "left")
    return out.select(*keys, "cells", *(f"median_{c}" for c in medians), *(f"mean_{c}" for c in means), *counts)


def image_medians(cells: DataFrame, keys: list[str], medians: list[str], means: list[str]) -> DataFrame:
    """Medians and means of each image; an image's cells are few, and its group is one aggregate."""
    return cells.groupBy(*keys).agg(*(F.median(c).alias(f"median_{c}") for c in medians), *(F.avg(c).alias(f"mean_{c}") for c in means))


def cluster_summary(cells: DataFrame, key: str, medians: list[str], border: str = "touches_image_border") -> DataFrame:
    """A row for each cluster: cells, medians, the share that touches the border, and its part of all cells."""
    out = group_summary(cells, [key], medians).join(cells.groupBy(key).agg(F.avg(E.truthy(F.col(border)).cast("double")).alias("border_touching_fraction")), key)
    return out.withColumn("cell_fraction", E.share_of_total("cells"))  # a row a cluster


def image_morphology(cells: DataFrame) -> DataFrame:
    """The per-image medians and means that are set beside the image's scores."""
    named = {"median": ("area", "solidity", "eccentricity", "extent", "neighbours_within_50px"), "mean": ("area", "solidity", "neighbours_within_50px", "nearest_neighbour_distance")}
    return image_medians(cells, ["image"], list(named["median"]), list(named["mean"]))


def with_morphology(scores: DataFrame, morphology: DataFrame) -> DataFrame:
    """Images that have both scores and measured cells."""
    return scores.join(morphology, "image", "inner")


def back_fill(cells: DataFrame, clustered: DataFrame, columns: list[str], keys: tuple[str, ...] = ("image", "cell_id")) -> DataFrame:
    """All cells with what only the clustered ones have: ``columns``, and the cluster's display label; NULL for the others."""
    out = cells.join(clustered.select(*keys, *columns), list(keys), "left")
    return out.withColumn("phenotype_cluster_label", E.cluster_label(F.col("phenotype_cluster"))) if "phenotype_cluster" in columns else out


def in_class_order(table: DataFrame, key: str, classes: list) -> DataFrame:
    """A row for each class in the order given, with what ``table`` has for it; others go."""
    order = table.sparkSession.createDataFrame([(i, c) for i, c in enumerate(classes)], f"class_order int, `{key}` {dict(table.dtypes)[key]}")
    return order.join(table, key, "left").orderBy("class_order")


def first_values(cells: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What each image's cells say of it.  The columns follow from the image; the least non-null value is given, so that no order matters."""
    return cells.groupBy(key).agg(*(F.min(c).alias(c) for c in columns))


def line_summary(raw: DataFrame, qc: DataFrame, images: DataFrame, limits: DataFrame, key: str = "cell_line") -> DataFrame:
    """A row for each line: cells, images, medians, quality counts, limits."""
    a = group_summary(raw, [key], ["area", "eccentricity", "solidity", "neighbours_within_50px"]).withColumnRenamed("cells", "predicted_cells")
    a = a.join(raw.groupBy(key).agg(F.countDistinct("image").alias("images_with_features")), key)
    fraction = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_fraction")
    b = qc.groupBy(key).agg(F.count_if("qc_include").alias("classifier_qc_passing_cells"), *(fraction(c) for c in ("qc_touches_image_border", "qc_extreme_area", "qc_missing_feature", "qc_include")))
    m = exact_medians(images, ["predicted_cells", "cell_coverage_fraction"], key).withColumnsRenamed({"predicted_cells": "median_cells_per_image", "cell_coverage_fraction": "median_cell_coverage_fraction"})
    c = images.groupBy(key).agg(F.count("*").alias("images_completed")).join(m, key, "left")
    return a.join(b, key, "left").join(c, key, "left").join(limits, key, "left")


def image_summary(cells: DataFrame, images: DataFrame, columns: list[str]) -> DataFrame:
    """Images of ``images`` (image, height, width), empty ones too: counts, density, medians, means."""
    s = cells.groupBy("image").agg(F.count("*").alias("predicted_cells"), F.sum("area").alias("covered"), F.count_if("touches_image_border").alias("border_touching_cells"), *(F.median(c).alias(f"median_{c}") for c in columns), *(F.avg(c).alias(f"mean_{c}") for c in columns))
    area = F.col("height") * F.col("width")
    out = images.join(s, "image", "left").withColumns({"predicted_cells": F.coalesce("predicted_cells", F.lit(0)), "border_touching_cells": F.coalesce("border_touching_cells", F.lit(0))})
    return out.withColumns({"cell_coverage_fraction": F.coalesce("covered", F.lit(0.0)) / area, "cell_density_per_100k_px": E.density(F.col("predicted_cells"), area), "border_touching_fraction": F.try_divide("border_touching_cells", "predicted_cells")}).drop("covered")


def composition(cells: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Counts and fractions of each ``part`` in every key, zeros filled in; NULL keys are left out."""
    for k in (*keys, part):
        cells = cells.where(F.col(k).isNotNull())
    n = cells.groupBy(*keys, part).agg(F.count("*").alias("cells"))
    # every key gets all parts, a handful of clusters, as an array
    grid = n.select(*keys).distinct().crossJoin(n.agg(F.collect_set(part).alias("__parts"))).select(*keys, F.explode("__parts").alias(part))
    out = grid.join(n, [*keys, part], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    total = F.sum("cells").over(Window.partitionBy(*keys))
    return out.withColumns({"total_cells": total, "cluster_fraction": F.col("cells") / total})


def quartile_bins(df: DataFrame, value: str, name: str, labels: list[str]) -> DataFrame:
    """Right-closed quartile bins, the lowest edge included; edges that fall together merge."""
    edges = quantiles(df, value, [0.0, 0.25, 0.5, 0.75, 1.0]).select(F.array_distinct("q").alias("e"))
    at = F.size(F.filter(F.slice(F.col("e"), F.lit(2), F.size("e") - 2), lambda x: x < F.col(value)))
    names = F.array(*map(F.lit, labels))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(value).isNotNull(), F.get(names, at))).drop("e")  # one row
