"""Queries of sources, rasters and per-cell tables.

A raster is drawn from the parts: 50 to a row, in blocks of 10 by 10; a block is a cell
unless its number is a multiple of 3, then it is background.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import cells, matching, stats
from ..operators.quantiles import quantiles
from ..sources import images
from .common import rounded as _r
from .common import scratch, table


def _raster(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row, col = F.floor(F.col("p_partkey") / 50).cast("int"), (F.col("p_partkey") % 50).cast("int")
    block = F.floor(row / 10) * 5 + F.floor(col / 10)
    return p.select(F.lit("grid").alias("image"), row.alias("row"), col.alias("col"), F.when(block % 3 == 0, 0).otherwise(block).cast("long").alias("label"), F.col("p_size").alias("intensity"))


def _grid_image(spark, sf_dir):
    return _raster(spark, sf_dir).groupBy("image").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


_RASTER = "raster AS (SELECT 'grid' AS image, (p_partkey // 50)::INT AS row, (p_partkey % 50)::INT AS col, CASE WHEN ((p_partkey // 500) * 5 + (p_partkey % 50) // 10) % 3 = 0 THEN 0 ELSE (p_partkey // 500) * 5 + (p_partkey % 50) // 10 END AS label, p_size AS intensity FROM part)"


def pixel_counts(spark, sf_dir):
    return _r(cells.pixel_counts(_raster(spark, sf_dir)))


def label_areas(spark, sf_dir):
    """Areas of labels, and their numbers without gaps."""
    p = _raster(spark, sf_dir)
    return matching.areas(p).join(cells.relabel(p), ["image", "label"])


def painted(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return matching.paint(li.select(F.col("l_returnflag").alias("image"), F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_orderkey") % 100).alias("label")))


def cell_table(spark, sf_dir):
    """All region properties and derived columns of the raster's cells, with literals of the run."""
    out = cells.cell_features(_raster(spark, sf_dir), _grid_image(spark, sf_dir))
    return _r(E.with_literals(cells.derived(out), "cpsam_v2", {"diameter": None, "cellprob_threshold": 0.0, "flow_threshold": 0.4, "min_size": 15}, modality="Phase"), 4)


def shapes(spark, sf_dir):
    """Pluses, corners and diagonals of several sizes: area, solidity and centre have closed forms."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), (F.col("p_partkey") % 3).alias("kind"), (F.floor(F.col("p_partkey") / 3) % 7 + 1).cast("int").alias("a"))
    point = lambda r, c: F.struct(r.cast("int").alias("row"), c.cast("int").alias("col"))
    zero, a = F.lit(0), F.col("a")
    plus = F.array_union(F.transform(F.sequence(-a, a), lambda i: point(i, zero)), F.transform(F.sequence(-a, a), lambda i: point(zero, i)))
    corner = F.array_union(F.transform(F.sequence(zero, a), lambda i: point(i, zero)), F.transform(F.sequence(zero, a), lambda i: point(a, i)))
    diagonal = F.transform(F.sequence(zero, a), lambda i: point(i, i))
    drawn = p.where("label > 0").select("label", F.explode(F.when(F.col("kind") == 0, plus).when(F.col("kind") == 1, corner).otherwise(diagonal)).alias("x"))
    pixels = drawn.select(F.lit("shapes").alias("image"), "label", F.col("x.row").alias("row"), F.col("x.col").alias("col"), F.lit(1).alias("intensity"))
    return _r(cells.moments(pixels).join(cells.outlines(pixels), ["image", "label"]).select("label", "area", "extent", "solidity"))


def rasterised(spark, sf_dir):
    """Right-angled polygons, and the same as run lengths: pixels and bounds of each."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"), (F.col("p_partkey") % 5 + 1).cast("int").alias("h"), (F.col("p_partkey") % 7 + 1).cast("int").alias("w"))
    d = lambda c: c.cast("double")
    one, right, low = F.lit(1.0), d(F.col("w") + 1), d(F.col("h") + 1)
    polygon = F.array(F.array(one, one, right, one, right, low, one, low))
    run = F.concat(F.array(F.lit(20 + 1).cast("int")), F.flatten(F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.array(F.col("h"), 20 - F.col("h")))))
    notes = p.select(F.lit("x").alias("image"), "label", F.when(F.col("label") % 2 == 0, polygon).alias("segmentation"), F.when(F.col("label") % 2 == 1, run).alias("runs"), F.lit(20).alias("height"), F.lit(20).alias("width"))
    return images.rasterise(notes).groupBy("label").agg(F.count("*").alias("pixels"), *(f(c).alias(f"{n}_{c}") for c in ("row", "col") for f, n in ((F.min, "min"), (F.max, "max"))))


def crops(spark, sf_dir):
    """Padded crops around the raster's cells, and around one that isn't there."""
    p = _raster(spark, sf_dir)
    boxes = cells.moments(p).select("image", F.col("label").alias("cell_id"), *(f"bbox_{x}" for x in ("min_row", "min_col", "max_row", "max_col")))
    boxes = boxes.unionByName(boxes.orderBy("cell_id").limit(1).withColumn("cell_id", F.lit(999).cast("long"))).join(_grid_image(spark, sf_dir), "image")
    out = cells.crops(p, boxes, 3)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, x: s + x["intensity"])
    return out.select("cell_id", "status", "row_from", "row_to", "col_from", "col_to", F.size("pixels").alias("n"), F.size(F.filter("pixels", lambda x: x["target"])).alias("n_target"), total.alias("intensity"))


def _catalogue(spark, sf_dir):
    """The customers as the images of an annotation file, the orders as its annotations; written and read again."""
    path = scratch(spark)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit(".tif")).alias("file_name"), F.lit(520).alias("height"), F.lit(704).alias("width"))
    ring = F.array(F.array(*(F.lit(x) for x in (0.0, 0.0, 2.0, 0.0, 2.0, 2.0))))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("image_id"), ring.alias("segmentation"))
    # a line a record, a comma before each but the first; the sorted parts become one file
    lines = lambda df, part: df.select(F.lit(part).alias("part"), "id", F.to_json(F.struct(*df.columns)).alias("line"), (F.col("id") == df.agg(F.min("id")).first()[0]).alias("first"))
    marks = spark.createDataFrame([(0, 0, '{"info": {"made": "{[,"}, "images": [', True), (2, 0, '], "annotations": [', True), (4, 0, "]}", True)], "part int, id long, line string, first boolean")
    every = marks.union(lines(c, 1)).union(lines(o, 3)).orderBy("part", "id")
    images.write_lines(every.select(F.when(F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), "line")).alias("value")), path)
    return images.read_coco(spark, path)


def catalogue_counts(spark, sf_dir):
    return images.catalogue_counts(*_catalogue(spark, sf_dir))


def first_image(spark, sf_dir):
    """The file's first image, and the one found by its name."""
    found, _ = _catalogue(spark, sf_dir)
    row = images.find_image(found, images.first_image(found).first()["file_name"])
    return images.first_image(found).select("pos", "id", "file_name").withColumn("by_name", F.lit(row["id"]).cast("long"))


def name_index(spark, sf_dir):
    return images.name_index(_catalogue(spark, sf_dir)[0])


def annotation_labels(spark, sf_dir):
    _, notes = _catalogue(spark, sf_dir)
    return notes.select("id", "image_id", "label", F.size(F.get("segmentation", F.lit(0))).alias("numbers"))


def tiff_round_trip(spark, sf_dir):
    """The raster's labels written as a TIFF file by the tasks, listed and read again."""
    folder, p = scratch(spark), _raster(spark, sf_dir)
    images.export_tiff(images.label_images(p, _grid_image(spark, sf_dir)), folder)
    return images.read_pixels(spark, folder).where("label > 0").join(images.list_files(spark, folder, "*.tif"), F.col("image") == F.col("file_name"), "left_semi")


def csv_round_trip(spark, sf_dir):
    """A sorted CSV with an index column, read again with its declared schema."""
    path = scratch(spark)
    images.write_table(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderpriority", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey"), path, "o_custkey", "o_orderkey", csv=True, index="o_orderkey")
    return images.read_table(spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string, o_custkey long")


def manifest(spark, sf_dir):
    """A run's manifest, written and read again."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderstatus").count().collect()  # a row a status
    images.write_manifest(spark, path := scratch(spark), {"seed": 42, "orders": {r[0]: r[1] for r in n}})
    got = images.read_manifest(spark, path)
    return spark.createDataFrame([(k, v, got["seed"]) for k, v in got["orders"].items()], "o_orderstatus string, orders long, seed long")


def existence(spark, sf_dir):
    """Images with and without a mask of the same configuration and shape: what is cached and what is left to do."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.lit("c1").alias("config_id"), F.lit(520).alias("height"), F.lit(704).alias("width"))
    masks = o.where("image % 3 = 0").withColumn("height", F.when(F.col("image") % 2 == 0, 520).otherwise(519))
    cached, todo = images.mask_cache(o, masks)
    return cached.withColumn("mask_source", F.lit("cached_mask")).unionByName(todo.withColumn("mask_source", F.lit("new_segmentation"))).select("image", "mask_source")


def forced_line(spark, sf_dir):
    """The line asked for stands, even where the name doesn't fit."""
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("BV2_Phase_A1_1_01d04h00m_"), (F.col("o_orderkey") % 4).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, ".png").otherwise(".tif"))
    return E.metadata_for_line(o.select("o_orderkey", "o_orderpriority", name.alias("image")), F.col("o_orderpriority")).select("o_orderkey", "cell_line", "well", "elapsed_hours", E.stem(F.col("image")).alias("stem"))


def count_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("t"), F.count("*").alias("p"), F.count_if(F.col("event_type") == "error").alias("m"))
    return _r(e.withColumns(E.count_ratios(F.col("t"), F.col("p"), F.col("m"))))


def expressions(spark, sf_dir):
    """The column expressions that are no operators of their own."""
    li, c = table(spark, sf_dir, "lineitem"), F.col
    p, r, f = E.scores(c("l_linenumber") - 1, c("l_quantity"), c("l_linenumber") % 2)
    out = {
        "aspect_ratio": E.aspect_ratio(c("l_quantity"), c("l_tax")), "circularity": E.circularity(c("l_quantity"), c("l_tax")), "edge_distance": E.edge_distance(c("l_quantity"), c("l_linenumber"), F.lit(50), F.lit(9)),
        "border": E.touches_border(c("l_linenumber") - 1, c("l_linenumber"), c("l_linenumber") + 1, c("l_quantity"), F.lit(7), F.lit(50)), "z": E.z_score(c("l_quantity"), F.lit(25.0), c("l_tax")), "density": E.density(c("l_linenumber"), c("l_quantity")),
        "log_value": E.positive_log(c("l_tax")), "precision": p, "recall": r, "f1": f, "truth": E.truthy(F.when(c("l_linenumber") == 1, " YES ").when(c("l_linenumber") == 2, "True").when(c("l_linenumber") == 3, "0")),
        "config": E.config_id(F.when(c("l_linenumber") > 2, c("l_linenumber")), c("l_tax") - 0.04, c("l_discount"), c("l_linenumber") * 5),
    }
    return _r(li.select("l_orderkey", "l_linenumber", "l_quantity", *(v.alias(k) for k, v in out.items())))


def image_table(spark, sf_dir):
    """Every order as an image, those without line items of status F as empty ones."""
    li = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'")
    own = li.select(F.col("l_orderkey").alias("image"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("solidity"), (F.col("l_linenumber") == 1).alias("touches_image_border"))
    each = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.lit(520).alias("height"), F.lit(704).alias("width"))
    return _r(cells.image_summary(own, each, ["area", "solidity"]), 4)


def _morphology(spark, sf_dir):
    li, c = table(spark, sf_dir, "lineitem"), F.col
    return li.select(c("l_orderkey").alias("image"), c("l_extendedprice").alias("area"), c("l_tax").alias("solidity"), c("l_discount").alias("eccentricity"), c("l_quantity").alias("extent"), c("l_linenumber").alias("neighbours_within_50px"), c("l_quantity").alias("nearest_neighbour_distance"))


def scores_with_morphology(spark, sf_dir):
    scores = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("image"), F.col("o_totalprice").alias("f1"))
    return _r(cells.with_morphology(scores, cells.image_morphology(_morphology(spark, sf_dir))))


def morphology_by_success(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("matched", F.col("l_tax") >= 0.04)
    return _r(cells.group_summary(li, ["matched"], ["l_quantity"], ["l_quantity", "l_extendedprice"]), 4)


def _clustered(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("image"), F.col("o_orderkey").alias("cell_id"), "o_totalprice", (F.col("o_orderkey") % 4 + 1).alias("phenotype_cluster"), (F.col("o_totalprice") / 1000).alias("PC1"), (F.col("o_custkey") % 5 == 0).alias("touches_image_border"), "o_orderstatus", F.col("o_orderdate").alias("taken"))


def back_fill(spark, sf_dir):
    every = _clustered(spark, sf_dir)
    return _r(cells.back_fill(every.select("image", "cell_id"), every.where("cell_id % 3 > 0"), ["PC1", "phenotype_cluster"]))


def cluster_summary(spark, sf_dir):
    return _r(cells.cluster_summary(_clustered(spark, sf_dir), "phenotype_cluster", ["o_totalprice"]))


def first_metadata(spark, sf_dir):
    o = _clustered(spark, sf_dir).withColumn("well", F.when(F.col("cell_id") % 2 == 0, F.concat(F.lit("W"), (F.col("image") % 9).cast("string"))))
    return cells.first_values(o, "image", ["well"])


def ordered_classes(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(F.count("*").alias("cells"))
    return cells.in_class_order(counts, "c_mktsegment", ["HOUSEHOLD", "BUILDING", "AUTOMOBILE", "none such"])


def describe(spark, sf_dir):
    return _r(stats.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"]), 4)


def exact_quantiles(spark, sf_dir):
    q = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.333, 1.0], "l_returnflag")
    return _r(q.select("l_returnflag", *(F.get("q", i).alias(f"q{i}") for i in range(3))), 3)


def sampled(spark, sf_dir):
    """How many rows a plot takes, and that they are rows of the table."""
    o = table(spark, sf_dir, "orders")
    return stats.sampled(o, 5000, 42, "o_orderkey").join(o.select("o_orderkey"), "o_orderkey", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("ids"))


QUERIES = {f.__name__: f for f in (
    pixel_counts, label_areas, painted, cell_table, shapes, rasterised, crops, catalogue_counts, first_image, name_index, annotation_labels, tiff_round_trip, csv_round_trip, manifest, existence, forced_line, count_ratios, expressions,
    image_table, scores_with_morphology, morphology_by_success, back_fill, cluster_summary, first_metadata, ordered_classes, describe, exact_quantiles, sampled,
)}

#: The raster's cells are rectangles: r rows, w columns.
_CELLS = f"""WITH {_RASTER},
i AS (SELECT avg(intensity) AS im, stddev_pop(intensity) AS istd, (max(row) + 1)::INT AS height, (max(col) + 1)::INT AS width FROM raster),
c AS (SELECT image, label AS cell_id, count(*)::DOUBLE AS area, min(row)::INT AS bbox_min_row, min(col)::INT AS bbox_min_col, (max(row) + 1)::INT AS bbox_max_row, (max(col) + 1)::INT AS bbox_max_col, avg(row) AS centroid_row, avg(col) AS centroid_col,
  avg(intensity) AS intensity_mean, median(intensity)::DOUBLE AS intensity_median, stddev_pop(intensity) AS intensity_std, min(intensity)::DOUBLE AS intensity_min, max(intensity)::DOUBLE AS intensity_max,
  var_pop(row) + 1 / 12::DOUBLE AS vr, var_pop(col) + 1 / 12::DOUBLE AS vc FROM raster WHERE label > 0 GROUP BY image, label),
d AS (SELECT *, bbox_max_row - bbox_min_row AS r, bbox_max_col - bbox_min_col AS w, greatest(vr, vc) AS l1, least(vr, vc) AS l2 FROM c, i),
n AS (SELECT a.cell_id, count(b.cell_id) FILTER (sqrt((a.centroid_row - b.centroid_row) ** 2 + (a.centroid_col - b.centroid_col) ** 2) <= 50) AS k, min(sqrt((a.centroid_row - b.centroid_row) ** 2 + (a.centroid_col - b.centroid_col) ** 2)) AS near FROM d a LEFT JOIN d b ON a.cell_id <> b.cell_id GROUP BY 1),
e AS (SELECT *, pi() / 4 * (r + w + sqrt(2) * (r + w - 1)) AS crofton, 4 * sqrt(l1) AS major, 4 * sqrt(l2) AS minor FROM d JOIN n USING (cell_id))"""

ORACLES = {
    "pixel_counts": f"WITH {_RASTER} SELECT image, count(*) FILTER (label = 0) AS background_pixels, count(*) FILTER (label > 0) AS cell_pixels, count(DISTINCT label) FILTER (label > 0) AS cells, round(count(*) FILTER (label > 0) / count(*)::DOUBLE, 6) AS coverage FROM raster GROUP BY 1",
    "label_areas": f"WITH {_RASTER} SELECT image, label, count(*) AS area, (row_number() OVER (ORDER BY label))::INT AS dense_label FROM raster WHERE label > 0 GROUP BY image, label",
    "painted": "SELECT l_returnflag AS image, l_suppkey AS row, l_linenumber AS col, max(l_orderkey % 100) AS label FROM lineitem GROUP BY ALL",
    "cell_table": f"""{_CELLS} SELECT image, cell_id, area, round(centroid_row, 4) AS centroid_row, round(centroid_col, 4) AS centroid_col, bbox_min_row, bbox_min_col, bbox_max_row, bbox_max_col, round(intensity_mean, 4) AS intensity_mean, intensity_median, round(intensity_std, 4) AS intensity_std, intensity_min, intensity_max,
 1.0::DOUBLE AS extent, round(sqrt(4 * area / pi()), 4) AS equivalent_diameter_area, round(major, 4) AS major_axis_length, round(minor, 4) AS minor_axis_length, round(sqrt(1 - l2 / l1), 4) AS eccentricity, round(CASE WHEN abs(vr - vc) < 1e-9 THEN -pi() / 4 ELSE 0.5::DOUBLE * atan2(0::DOUBLE, vr - vc) END, 4) AS orientation,
 round(CASE WHEN r = 1 OR w = 1 THEN greatest(r, w) - 1 ELSE 2 * (r + w) - 4 END::DOUBLE, 4) AS perimeter, round(crofton, 4) AS perimeter_crofton, 1.0::DOUBLE AS solidity, height, width, round(im, 4) AS image_intensity_mean, round(istd, 4) AS image_intensity_std,
 round(major / minor, 4) AS aspect_ratio, round(4 * pi() * area / crofton ** 2, 4) AS circularity, round(least(centroid_row, centroid_col, height - 1 - centroid_row, width - 1 - centroid_col), 4) AS centroid_to_edge_distance,
 bbox_min_row <= 0 OR bbox_min_col <= 0 OR bbox_max_row >= height OR bbox_max_col >= width AS touches_image_border, round((intensity_mean - im) / istd, 4) AS cell_mean_intensity_zscore, k AS neighbours_within_50px, round(near, 4) AS nearest_neighbour_distance,
 round(ln(area), 4) AS log_area, round(ln(major / minor), 4) + 0 AS log_aspect_ratio, round(ln(1 + k), 4) AS log_neighbours_within_50px, CASE WHEN near > 0 THEN round(ln(near), 4) END AS log_nearest_neighbour_distance,
 'Phase' AS modality, 'cpsam_v2' AS model_name, NULL::INT AS cellpose_diameter, 0.0::DOUBLE AS cellpose_cellprob_threshold, 0.4::DOUBLE AS cellpose_flow_threshold, 15 AS cellpose_min_size FROM e""",
    "shapes": """WITH s AS (SELECT p_partkey AS label, p_partkey % 3 AS kind, ((p_partkey // 3) % 7 + 1)::DOUBLE AS a FROM part WHERE p_partkey > 0)
SELECT label, CASE kind WHEN 0 THEN 4 * a + 1 WHEN 1 THEN 2 * a + 1 ELSE a + 1 END AS area, round(CASE kind WHEN 0 THEN (4 * a + 1) / (2 * a + 1) ** 2 WHEN 1 THEN (2 * a + 1) / (a + 1) ** 2 ELSE 1 / (a + 1) END, 6) AS extent,
 round(CASE kind WHEN 0 THEN (4 * a + 1) / (2 * a * (a + 1) + 1) WHEN 1 THEN (2 * a + 1) / ((a + 1) * (a + 2) / 2) ELSE 1 END, 6) AS solidity FROM s""",
    "rasterised": "SELECT p_partkey AS label, (p_partkey % 5 + 1) * (p_partkey % 7 + 1) AS pixels, 1 AS min_row, (p_partkey % 5 + 1)::INT AS max_row, 1 AS min_col, (p_partkey % 7 + 1)::INT AS max_col FROM part",
    "crops": f"""WITH {_RASTER}, b AS (SELECT label AS cell_id, min(row) AS r0, max(row) + 1 AS r1, min(col) AS c0, max(col) + 1 AS c1 FROM raster WHERE label > 0 GROUP BY 1), h AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM raster),
w AS (SELECT cell_id, greatest(0, r0 - 3)::INT AS row_from, least(h, r1 + 3)::INT AS row_to, greatest(0, c0 - 3)::INT AS col_from, least(w, c1 + 3)::INT AS col_to FROM (SELECT * FROM b UNION ALL (SELECT 999, r0, r1, c0, c1 FROM b ORDER BY cell_id LIMIT 1)), h)
SELECT cell_id, CASE WHEN count(*) FILTER (label = cell_id) > 0 THEN 'ok' ELSE 'label_not_found' END AS status, row_from, row_to, col_from, col_to, count(*)::INT AS n, (count(*) FILTER (label = cell_id))::INT AS n_target, sum(intensity)::BIGINT AS intensity FROM w JOIN raster ON row >= row_from AND row < row_to AND col >= col_from AND col < col_to GROUP BY ALL""",
    "catalogue_counts": "SELECT (SELECT count(*) FROM customer) AS images, (SELECT count(*) FROM orders) AS annotations",
    "first_image": "WITH f AS (SELECT c_custkey AS id, c_mktsegment || '_' || c_nationkey || '.tif' AS file_name FROM customer) SELECT 0 AS pos, id, file_name, id AS by_name FROM f ORDER BY id LIMIT 1",
    "name_index": "SELECT c_mktsegment || '_' || c_nationkey || '.tif' AS file_name, max(c_custkey) AS image_id FROM customer GROUP BY 1",
    "annotation_labels": "SELECT o_orderkey AS id, o_custkey AS image_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INT AS label, 6 AS numbers FROM orders",
    "tiff_round_trip": f"WITH {_RASTER} SELECT 'grid_optimized_masks.tif' AS image, row, col, label FROM raster WHERE label > 0",
    "csv_round_trip": "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS o_custkey FROM orders",
    "manifest": "SELECT o_orderstatus, count(*) AS orders, 42::BIGINT AS seed FROM orders GROUP BY 1",
    "existence": "SELECT o_orderkey AS image, CASE WHEN o_orderkey % 6 = 0 THEN 'cached_mask' ELSE 'new_segmentation' END AS mask_source FROM orders",
    "forced_line": "SELECT o_orderkey, o_orderpriority AS cell_line, CASE WHEN o_orderkey % 5 > 0 THEN 'A1' END AS well, CASE WHEN o_orderkey % 5 > 0 THEN 28.0::DOUBLE END AS elapsed_hours, 'BV2_Phase_A1_1_01d04h00m_' || (o_orderkey % 4) AS stem FROM orders",
    "count_ratios": "WITH e AS (SELECT user_id, count(*) FILTER (event_type = 'click') AS t, count(*) AS p, count(*) FILTER (event_type = 'error') AS m FROM events GROUP BY 1) SELECT *, round(p / nullif(t, 0)::DOUBLE, 6) AS prediction_to_truth_ratio, round(m / nullif(t, 0)::DOUBLE, 6) AS false_negative_rate FROM e",
    "expressions": """WITH x AS (SELECT *, l_linenumber - 1 AS tp, l_quantity AS fp, l_linenumber % 2 AS fn FROM lineitem)
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_tax > 0 THEN round(l_quantity / l_tax, 6) END AS aspect_ratio, CASE WHEN l_tax > 0 THEN round(4 * pi() * l_quantity / (l_tax * l_tax), 6) END AS circularity, least(l_quantity, l_linenumber, 49 - l_quantity, 8 - l_linenumber)::DOUBLE AS edge_distance,
 l_linenumber <= 1 OR l_linenumber <= 0 OR l_linenumber + 1 >= 7 OR l_quantity >= 50 AS border, CASE WHEN l_tax > 0 THEN round((l_quantity - 25) / l_tax, 6) END AS z, round(l_linenumber / l_quantity * 100000, 6) AS density, CASE WHEN l_tax > 0 THEN round(ln(l_tax), 6) END AS log_value,
 round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, l_linenumber IN (1, 2) AS truth,
 'diameter_' || CASE WHEN l_linenumber > 2 THEN l_linenumber::VARCHAR ELSE 'native' END || '__cellprob_' || format('{:+.1f}', l_tax - 0.04) || '__flow_' || format('{:.1f}', l_discount) || '__minsize_' || (l_linenumber * 5) AS config FROM x""",
    "image_table": """WITH s AS (SELECT l_orderkey AS image, count(*) AS n, sum(l_quantity) AS covered, count(*) FILTER (l_linenumber = 1) AS b, median(l_quantity) AS ma, median(l_extendedprice) AS ms, avg(l_quantity) AS aa, avg(l_extendedprice) AS xs FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS image, 520 AS height, 704 AS width, coalesce(n, 0) AS predicted_cells, coalesce(b, 0) AS border_touching_cells, round(ma, 4) AS median_area, round(ms, 4) AS median_solidity, round(aa, 4) AS mean_area, round(xs, 4) AS mean_solidity, round(coalesce(covered, 0) / 366080::DOUBLE, 4) AS cell_coverage_fraction, round(coalesce(n, 0) / 366080::DOUBLE * 100000, 4) AS cell_density_per_100k_px, round(b / n::DOUBLE, 4) AS border_touching_fraction FROM orders LEFT JOIN s ON image = o_orderkey""",
    "scores_with_morphology": "SELECT o_orderkey AS image, round(any_value(o_totalprice), 6) AS f1, round(median(l_extendedprice), 6) AS median_area, round(median(l_tax), 6) AS median_solidity, round(median(l_discount), 6) AS median_eccentricity, round(median(l_quantity), 6) AS median_extent, round(median(l_linenumber), 6) AS median_neighbours_within_50px, round(avg(l_extendedprice), 6) AS mean_area, round(avg(l_tax), 6) AS mean_solidity, round(avg(l_linenumber), 6) AS mean_neighbours_within_50px, round(avg(l_quantity), 6) AS mean_nearest_neighbour_distance FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 GROUP BY 1",
    "morphology_by_success": "SELECT l_tax >= 0.04 AS matched, count(*) AS cells, round(median(l_quantity), 4) AS median_l_quantity, round(avg(l_quantity), 4) AS mean_l_quantity, round(avg(l_extendedprice), 4) AS mean_l_extendedprice FROM lineitem GROUP BY 1",
    "back_fill": "SELECT o_custkey AS image, o_orderkey AS cell_id, CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice / 1000, 6) END AS PC1, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 4 + 1 END AS phenotype_cluster, CASE WHEN o_orderkey % 3 > 0 THEN 'Morphology cluster ' || (o_orderkey % 4 + 1) END AS phenotype_cluster_label FROM orders",
    "cluster_summary": "SELECT o_orderkey % 4 + 1 AS phenotype_cluster, count(*) AS cells, round(median(o_totalprice), 6) AS median_o_totalprice, round(avg((o_custkey % 5 = 0)::INT), 6) AS border_touching_fraction, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 6) AS cell_fraction FROM orders GROUP BY 1",
    "first_metadata": "SELECT o_custkey AS image, min(CASE WHEN o_orderkey % 2 = 0 THEN 'W' || (o_custkey % 9) END) AS well FROM orders GROUP BY 1",
    "ordered_classes": "WITH c AS (SELECT c_mktsegment, count(*) AS cells FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1) SELECT class_order, k.c_mktsegment, cells FROM (VALUES (0, 'HOUSEHOLD'), (1, 'BUILDING'), (2, 'AUTOMOBILE'), (3, 'none such')) k(class_order, c_mktsegment) LEFT JOIN c USING (c_mktsegment)",
    "describe": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")),
    "exact_quantiles": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 3) AS q0, round(quantile_cont(l_extendedprice, 0.333), 3) AS q1, round(max(l_extendedprice), 3) AS q2 FROM lineitem GROUP BY 1",
    "sampled": "SELECT least(count(*), 5000) AS n, least(count(*), 5000) AS ids FROM orders",
}
