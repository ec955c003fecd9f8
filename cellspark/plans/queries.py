"""Registered queries: every operator applied to the driver's tables, with its SQL.

The tables hold no images, so rows stand in: a line item is a pixel (its line status the
image, its supplier the annotated object; the predicted one is the same for most of them,
the next for some, and background for the rest), an
event a cell, a customer a well, and so on.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import bootstrap, cells, matching, phenotypes, stats
from ..operators.tables import written
from . import experiments, records
from .common import rounded as _r
from .common import table


def _pairs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_linestatus").alias("image"), F.col("l_suppkey").alias("gt_label"), (F.col("l_partkey") % 50).alias("pred_label"))


def _predicted_pairs(spark, sf_dir):
    """Most pixels of an object are predicted as the object itself, some as the next one or as background."""
    li = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") % 100
    pred = F.when(part < 62 + F.col("l_suppkey") % 13, F.col("l_suppkey")).when(part < 90, F.col("l_suppkey") + 1).otherwise(F.lit(0))
    return li.select(F.col("l_linestatus").alias("image"), F.col("l_suppkey").alias("gt_label"), pred.alias("pred_label"))


def _assigned(spark, sf_dir):
    return matching.assign(matching.overlaps(_predicted_pairs(spark, sf_dir)))


def overlap_iou(spark, sf_dir):
    return _r(matching.overlaps(_pairs(spark, sf_dir)))


def best_match_per_truth(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return _r(matching.best_match(matching.overlaps(pairs), pairs.where("gt_label > 0"), "gt_label", "pred_label"))


def match_metrics(spark, sf_dir):
    pairs = _predicted_pairs(spark, sf_dir)
    n = lambda c: F.countDistinct(F.when(F.col(c) > 0, F.col(c)))
    return _r(matching.match_metrics(_assigned(spark, sf_dir), pairs.groupBy("image").agg(n("gt_label").alias("n_gt"), n("pred_label").alias("n_pred"))))


def micro_summary(spark, sf_dir):
    return _r(matching.micro_summary(match_metrics(spark, sf_dir)))


def assignment(spark, sf_dir):
    return _r(_assigned(spark, sf_dir))


def area_limits(spark, sf_dir):
    return _r(cells.area_limits(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.005, 0.995, "l_returnflag"), 2)


def _flagged(spark, sf_dir, limits=None):
    li = table(spark, sf_dir, "lineitem").withColumn("half", F.when(F.col("l_tax") > 0, 1 / F.col("l_tax")))
    limits = limits or cells.area_limits(li, "l_extendedprice", 0.01, 0.99, "l_returnflag")
    return cells.qc_flags(li, limits, "l_extendedprice", ["half", "l_quantity"], F.col("l_linenumber") == 7, "l_returnflag")


def qc_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("l_orderkey", "l_linenumber", "qc_touches_image_border", "qc_extreme_area", "qc_missing_feature", "qc_include", "qc_exclusion_reason")


def qc_accounting(spark, sf_dir):
    return cells.qc_accounting(_flagged(spark, sf_dir))


def spearman(spark, sf_dir):
    return _r(stats.spearman(table(spark, sf_dir, "events"), "value", "user_id"))


def mann_whitney_u(spark, sf_dir):
    return _r(stats.mann_whitney(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_linestatus"), 1)


def adjusted_rand(spark, sf_dir):
    return _r(stats.adjusted_rand(table(spark, sf_dir, "embeddings").withColumn("other", F.col("vec_id") % 7), "label", "other"))


def crowding(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("y", F.minute("ts"))
    return _r(cells.crowding(ev, "user_id", "event_id", "y", "value"))


def filename_metadata(spark, sf_dir):
    """Wells in either case, times with one or more digits, and names that don't fit."""
    text = lambda c, m: (F.col(c) % m).cast("string")
    name = F.concat(F.lit("A172_Phase_"), F.when(F.col("event_id") % 10 == 0, "d").when(F.col("event_id") % 11 == 0, "_").otherwise("D"), text("user_id", 12), F.lit("_"), text("event_id", 4), F.lit("_"), F.when(F.col("event_id") % 3 == 0, F.lpad(text("event_id", 5), 2, "0")).otherwise(text("event_id", 113)), F.lit("d"), text("event_id", 24), F.lit("h30m_"), text("event_id", 3), F.when(F.col("event_id") % 7 == 0, ".png").otherwise(".tif"))
    return _r(E.add_filename_metadata(table(spark, sf_dir, "events").select("event_id", name.alias("image"))))


def composition_zero_fill(spark, sf_dir):
    return _r(cells.composition(table(spark, sf_dir, "events"), ["user_id"], "event_type"))


def quartile_bins(spark, sf_dir):
    binned = cells.quartile_bins(table(spark, sf_dir, "orders"), "o_totalprice", "crowding_quartile", ["Q1", "Q2", "Q3", "Q4"])
    out = cells.group_summary(binned, ["crowding_quartile"], ["o_totalprice"], ["o_totalprice"])
    return _r(out.withColumnsRenamed({"mean_o_totalprice": "mean_value", "median_o_totalprice": "median_value"}), 2)


def robust_scale(spark, sf_dir):
    return _r(stats.robust_scale(table(spark, sf_dir, "part"), ["p_retailprice"]).select("p_partkey", "p_retailprice_scaled"))


def relative_profile(spark, sf_dir):
    return _r(stats.relative_profile(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_extendedprice", "l_quantity"]))


def line_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    as_cells = {"cell_line": F.col("l_returnflag"), "image": F.col("l_orderkey"), "area": F.col("l_extendedprice"), "eccentricity": F.col("l_discount"), "solidity": F.col("l_tax"), "neighbours_within_50px": F.col("l_quantity")}
    raw = li.withColumns(as_cells)
    images = raw.groupBy("cell_line", "image").agg(F.count("*").alias("predicted_cells"), (F.sum("l_quantity") / 1000).alias("cell_coverage_fraction"))
    limits = written(cells.area_limits(raw, "area", 0.01, 0.99, "cell_line"))
    flagged = _flagged(spark, sf_dir, limits.withColumnRenamed("cell_line", "l_returnflag")).withColumnRenamed("l_returnflag", "cell_line")
    return _r(cells.line_summary(raw, flagged, images, limits), 4)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


def select_best(spark, sf_dir):
    o = _orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("f1"), F.max("o_totalprice").alias("mean_matched_iou"), F.min("o_totalprice").alias("recall"))
    return matching.select_best(o, "o_orderpriority")


def lowest_k(spark, sf_dir):
    return stats.top_k(_orders(spark, sf_dir), 15, F.asc("o_totalprice"), F.asc("o_orderkey"))


def diverse_top_n(spark, sf_dir):
    return stats.diverse_top(_orders(spark, sf_dir), "o_orderpriority", "o_custkey", [F.asc("o_totalprice"), F.asc("o_orderkey")], 6)


def even_spaced_pick(spark, sf_dir):
    return stats.even_pick(_orders(spark, sf_dir), "o_orderpriority", "o_orderkey", 33).select("o_orderpriority", "selection_rank", "o_orderkey")


def capped_first_n(spark, sf_dir):
    """Priority 5 has no annotation file; of the others every third customer is in theirs."""
    annotated = ~F.col("o_orderpriority").startswith("5")
    return stats.capped_status(_orders(spark, sf_dir), "o_orderpriority", "o_orderkey", F.col("o_custkey") % 3 == 0, 20, annotated).select("o_orderkey", "status")


def _predicted(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("predicted", F.when(F.col("vec_id") % 3 == 0, F.lit(1)).otherwise(F.col("label")).cast("int"))


def confusion(spark, sf_dir):
    out = stats.confusion(_predicted(spark, sf_dir), "label", "predicted", list(range(10)))
    return out.select("label", *(F.col(str(i)).alias(f"c{i}") for i in range(10)))


def class_metrics(spark, sf_dir):
    return _r(stats.class_metrics(_predicted(spark, sf_dir), "label", "predicted"))


def left_anti_missing(spark, sf_dir):
    urgent = _orders(spark, sf_dir).where(F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def semi_member(spark, sf_dir):
    urgent = _orders(spark, sf_dir).where(F.col("o_orderpriority").startswith("1"))
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def leak_check(spark, sf_dir):
    """A customer's orders fall into several folds, so groups do stand on both sides."""
    o = _orders(spark, sf_dir).withColumn("fold", F.col("o_orderkey") % 5)
    return stats.leaks(o.where("fold <> 0"), o.where("fold = 0"), "o_custkey")


def group_counts(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("o_orderpriority").agg(F.countDistinct(E.group_key("o_orderpriority", "o_custkey")).alias("n_groups"), F.count("*").alias("cells"))


def polygon_points(spark, sf_dir):
    o = _orders(spark, sf_dir).select("o_orderkey", F.sequence(F.lit(0), (F.col("o_orderkey") % 9).cast("int")).alias("flat"))
    return o.select("o_orderkey", F.posexplode(E.polygon_points(F.col("flat"))).alias("point", "p")).select("o_orderkey", "point", "p.x", "p.y")


def first_occurrence(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return _orders(spark, sf_dir).withColumn("label", F.row_number().over(w)).select("o_orderkey", "o_custkey", "label")


def pca_scores(spark, sf_dir):
    """All 64 numbers of the embeddings."""
    return phenotypes.pca_variance(phenotypes.spread(table(spark, sf_dir, "embeddings"), "embedding", 64), [f"f{i}" for i in range(64)])


def kmeans_labels(spark, sf_dir):
    """All 64 numbers of the embeddings, 3 clusters, 20 starts."""
    e = phenotypes.spread(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return phenotypes.cluster(e, [f"f{i}" for i in range(64)], 3, order_by="f0").select("vec_id", "phenotype_cluster")


def bootstrap_means(spark, sf_dir):
    """Both ends of each interval, held against the normal approximation of the mean's spread."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.avg("o_totalprice").alias("v"))
    spread = o.groupBy("o_orderpriority").agg((F.stddev_pop("v") / F.sqrt(F.count("*"))).alias("se"))
    out = bootstrap.means(o, ["o_orderpriority"], "v").join(spread, "o_orderpriority")
    width = lambda c: (F.abs(F.col(c) - F.col("mean")) / F.col("se")).between(1.7, 2.25)
    held = (F.col("ci_lower") < F.col("mean")) & (F.col("mean") < F.col("ci_upper"))
    return _r(out.select("o_orderpriority", "n_images", "mean", held.alias("holds_mean"), (width("ci_lower") & width("ci_upper")).alias("is_interval")), 4)


QUERIES = {f.__name__: f for f in (
    overlap_iou, best_match_per_truth, match_metrics, micro_summary, assignment, area_limits, qc_flags, qc_accounting, spearman, mann_whitney_u, adjusted_rand, crowding,
    filename_metadata, composition_zero_fill, quartile_bins, robust_scale, relative_profile, line_summary, select_best, lowest_k, diverse_top_n, even_spaced_pick, capped_first_n,
    confusion, class_metrics, left_anti_missing, semi_member, leak_check, group_counts, polygon_points, first_occurrence, pca_scores, kmeans_labels, bootstrap_means,
)} | records.QUERIES | experiments.QUERIES

_PAIRS = "pairs AS (SELECT l_linestatus AS image, l_suppkey AS gt_label, l_partkey % 50 AS pred_label FROM lineitem)"
_OVERLAPS = f"""{_PAIRS},
n AS (SELECT image, gt_label, pred_label, count(*) AS n FROM pairs GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY image, gt_label)::BIGINT AS gt_area, sum(n) OVER (PARTITION BY image, pred_label)::BIGINT AS pred_area FROM n),
o AS (SELECT *, n::DOUBLE / (gt_area + pred_area - n) AS iou FROM a WHERE gt_label > 0 AND pred_label > 0)"""
_BEST = f"""{_OVERLAPS},
ranked AS (SELECT image, gt_label, pred_label, iou, row_number() OVER (PARTITION BY image, gt_label ORDER BY iou DESC, pred_label) AS k FROM o),
best AS (SELECT l.image, l.gt_label, coalesce(r.pred_label, 1) AS best_pred_label, coalesce(r.iou, 0.0) AS best_iou
  FROM (SELECT DISTINCT image, gt_label FROM pairs WHERE gt_label > 0) l LEFT JOIN ranked r ON l.image = r.image AND l.gt_label = r.gt_label AND r.k = 1)"""
#: Every object's own prediction overlaps it most, so the best assignment pairs each object with itself.
_ASSIGNED = """pairs AS (SELECT l_linestatus AS image, l_suppkey AS gt_label, CASE WHEN l_partkey % 100 < 62 + l_suppkey % 13 THEN l_suppkey WHEN l_partkey % 100 < 90 THEN l_suppkey + 1 ELSE 0 END AS pred_label FROM lineitem),
n AS (SELECT image, gt_label, pred_label, count(*) AS n FROM pairs GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY image, gt_label) AS g, sum(n) OVER (PARTITION BY image, pred_label) AS p FROM n),
m AS (SELECT image, gt_label, pred_label, n::DOUBLE / (g + p - n) AS iou FROM a WHERE gt_label > 0 AND gt_label = pred_label)"""
_METRICS = f"""{_ASSIGNED},
c AS (SELECT image, count(DISTINCT CASE WHEN gt_label > 0 THEN gt_label END) AS n_gt, count(DISTINCT CASE WHEN pred_label > 0 THEN pred_label END) AS n_pred FROM pairs GROUP BY image),
t AS (SELECT image, count(*) FILTER (iou >= 0.5) AS tp, sum(iou) FILTER (iou >= 0.5) AS s, avg(iou) FILTER (iou >= 0.5) AS mean_iou FROM m GROUP BY image),
x AS (SELECT c.image, n_gt, n_pred, coalesce(tp, 0) AS true_positives, coalesce(s, 0.0) AS matched_iou_sum, mean_iou AS mean_matched_iou,
  n_pred - coalesce(tp, 0) AS false_positives, n_gt - coalesce(tp, 0) AS false_negatives FROM c LEFT JOIN t USING (image))"""
_SCORES = """round(coalesce(true_positives / nullif(true_positives + false_positives, 0)::DOUBLE, 0), 6) AS precision,
  round(coalesce(true_positives / nullif(true_positives + false_negatives, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * true_positives / nullif(2 * true_positives + false_positives + false_negatives, 0)::DOUBLE, 0), 6) AS f1"""
_FLAGS = """lim AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem GROUP BY 1),
f AS (SELECT l_returnflag, l_orderkey, l_linenumber, l_linenumber = 7 AS b, coalesce(l_extendedprice < lo OR l_extendedprice > hi, false) AS e, NOT (l_tax > 0 AND l_tax IS NOT NULL AND l_quantity IS NOT NULL) AS m
  FROM lineitem JOIN lim USING (l_returnflag))"""

ORACLES = {
    "overlap_iou": f"WITH {_OVERLAPS} SELECT image, gt_label, pred_label, n, gt_area, pred_area, round(iou, 6) AS iou FROM o",
    "best_match_per_truth": f"WITH {_BEST} SELECT image, gt_label, best_pred_label, round(best_iou, 6) AS best_iou, best_iou >= 0.5 AS matched FROM best",
    "match_metrics": f"WITH {_METRICS} SELECT image, n_gt, n_pred, true_positives, round(matched_iou_sum, 6) AS matched_iou_sum, round(mean_matched_iou, 6) AS mean_matched_iou, false_positives, false_negatives, {_SCORES} FROM x",
    "micro_summary": f"WITH {_METRICS}, u AS (SELECT count(*) AS images, sum(true_positives)::BIGINT AS true_positives, sum(false_positives)::BIGINT AS false_positives, sum(false_negatives)::BIGINT AS false_negatives, sum(round(matched_iou_sum, 6)) AS s FROM x) SELECT images, true_positives, false_positives, false_negatives, {_SCORES}, round(s / true_positives, 6) AS mean_matched_iou FROM u",
    "assignment": f"WITH {_ASSIGNED} SELECT image, gt_label, pred_label, round(iou, 6) AS iou, iou >= 0.5 AS matched FROM m",
    "area_limits": "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.005), 2) AS area_qc_lower, round(quantile_cont(l_extendedprice, 0.995), 2) AS area_qc_upper FROM lineitem GROUP BY 1",
    "qc_flags": f"WITH {_FLAGS} SELECT l_orderkey, l_linenumber, b AS qc_touches_image_border, e AS qc_extreme_area, m AS qc_missing_feature, NOT (b OR e OR m) AS qc_include, CASE WHEN NOT (b OR e OR m) THEN 'included' ELSE concat_ws(';', CASE WHEN b THEN 'image_border' END, CASE WHEN e THEN 'extreme_area' END, CASE WHEN m THEN 'missing_feature' END) END AS qc_exclusion_reason FROM f",
    "qc_accounting": f"WITH {_FLAGS} SELECT count(*) AS cells, count(*) FILTER (b) AS qc_touches_image_border, count(*) FILTER (e) AS qc_extreme_area, count(*) FILTER (m) AS qc_missing_feature, count(*) FILTER (NOT (b OR e OR m)) AS qc_include FROM f",
    "spearman": "WITH r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0::DOUBLE AS rb FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) SELECT round(corr(ra, rb), 6) AS rho, count(*) AS n FROM r",
    "mann_whitney_u": "WITH r AS (SELECT l_linestatus, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0::DOUBLE AS r FROM lineitem), t AS (SELECT sum(k ** 3 - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM lineitem GROUP BY l_extendedprice)) SELECT l_linestatus, count(*) AS n, round(sum(r) - count(*) * (count(*) + 1) / 2.0::DOUBLE, 1) AS u, any_value(ties) AS ties FROM r, t GROUP BY 1",
    "adjusted_rand": "WITH n AS (SELECT label, vec_id % 7 AS other, count(*)::DOUBLE AS n FROM embeddings GROUP BY ALL), pa AS (SELECT sum(s * (s - 1) / 2) AS p FROM (SELECT sum(n) AS s FROM n GROUP BY label)), pb AS (SELECT sum(s * (s - 1) / 2) AS p FROM (SELECT sum(n) AS s FROM n GROUP BY other)), t AS (SELECT sum(n * (n - 1) / 2) AS pn, sum(n) AS t FROM n) SELECT round((pn - pa.p * pb.p / (t * (t - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (t * (t - 1) / 2)), 6) AS ari FROM t, pa, pb",
    "crowding": "WITH p AS (SELECT user_id, event_id, minute(ts)::DOUBLE AS y, value AS x FROM events), d AS (SELECT a.user_id, a.event_id, sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS d FROM p a JOIN p b ON a.user_id = b.user_id AND a.event_id <> b.event_id) SELECT p.user_id, p.event_id, count(d) FILTER (d <= 50) AS neighbours_within_50px, round(min(d), 6) AS nearest_neighbour_distance FROM p LEFT JOIN d USING (user_id, event_id) GROUP BY ALL",
    "filename_metadata": r"""WITH n AS (SELECT event_id, 'A172_Phase_' || CASE WHEN event_id % 10 = 0 THEN 'd' WHEN event_id % 11 = 0 THEN '_' ELSE 'D' END || (user_id % 12) || '_' || (event_id % 4) || '_' || CASE WHEN event_id % 3 = 0 THEN lpad((event_id % 5)::VARCHAR, 2, '0') ELSE (event_id % 113)::VARCHAR END || 'd' || (event_id % 24) || 'h30m_' || (event_id % 3) || CASE WHEN event_id % 7 = 0 THEN '.png' ELSE '.tif' END AS image FROM events),
g AS (SELECT *, event_id % 7 <> 0 AND (event_id % 11 <> 0 OR event_id % 10 = 0) AS ok FROM n)
SELECT event_id, image, CASE WHEN ok THEN 'A172' END AS cell_line, CASE WHEN ok THEN 'Phase' END AS modality, CASE WHEN ok THEN split_part(image, '_', 3) END AS well, CASE WHEN ok THEN split_part(image, '_', 4)::INT END AS location, CASE WHEN ok THEN split_part(image, '_', 5) END AS elapsed_time, CASE WHEN ok THEN round(CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE event_id % 113 END * 24 + event_id % 24 + 0.5::DOUBLE, 6) END AS elapsed_hours, CASE WHEN ok THEN (event_id % 3)::INT END AS crop FROM g""",
    "composition_zero_fill": "WITH n AS (SELECT user_id, event_type, count(*) AS cells FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT user_id FROM n), (SELECT DISTINCT event_type FROM n)), f AS (SELECT user_id, event_type, coalesce(cells, 0) AS cells FROM g LEFT JOIN n USING (user_id, event_type)) SELECT *, (sum(cells) OVER (PARTITION BY user_id))::BIGINT AS total_cells, round(cells / sum(cells) OVER (PARTITION BY user_id), 6) AS cluster_fraction FROM f",
    "quartile_bins": "WITH e AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT CASE WHEN o_totalprice <= a THEN 'Q1' WHEN o_totalprice <= b THEN 'Q2' WHEN o_totalprice <= c THEN 'Q3' ELSE 'Q4' END AS crowding_quartile, count(*) AS cells, round(avg(o_totalprice), 2) AS mean_value, round(median(o_totalprice), 2) AS median_value FROM orders, e GROUP BY 1",
    "robust_scale": "SELECT p_partkey, round((p_retailprice - m) / CASE WHEN h = l THEN 1 ELSE h - l END, 6) AS p_retailprice_scaled FROM part, (SELECT median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.25) AS l, quantile_cont(p_retailprice, 0.75) AS h FROM part)",
    "relative_profile": "SELECT l_returnflag, round((median(l_extendedprice) - any_value(m1)) / any_value(h1 - l1), 6) AS l_extendedprice, round((median(l_quantity) - any_value(m2)) / any_value(h2 - l2), 6) AS l_quantity FROM lineitem, (SELECT median(l_extendedprice) AS m1, quantile_cont(l_extendedprice, 0.25) AS l1, quantile_cont(l_extendedprice, 0.75) AS h1, median(l_quantity) AS m2, quantile_cont(l_quantity, 0.25) AS l2, quantile_cont(l_quantity, 0.75) AS h2 FROM lineitem) GROUP BY 1",
    "line_summary": f"""WITH {_FLAGS}, i AS (SELECT l_returnflag, l_orderkey, count(*) AS n, sum(l_quantity) / 1000 AS c FROM lineitem GROUP BY ALL),
j AS (SELECT l_returnflag, count(*) AS images_completed, median(n) AS mn, median(c) AS mc FROM i GROUP BY 1),
q AS (SELECT l_returnflag, count(*) FILTER (NOT (b OR e OR m)) AS ok, avg(b::INT) AS b, avg(e::INT) AS e, avg(m::INT) AS m, avg((NOT (b OR e OR m))::INT) AS i FROM f GROUP BY 1)
SELECT l_returnflag AS cell_line, count(*) AS predicted_cells, round(median(l_extendedprice), 4) AS median_area, round(median(l_discount), 4) AS median_eccentricity, round(median(l_tax), 4) AS median_solidity, round(median(l_quantity), 4) AS median_neighbours_within_50px,
  count(DISTINCT l_orderkey) AS images_with_features, any_value(ok) AS classifier_qc_passing_cells, round(any_value(q.b), 4) AS qc_touches_image_border_fraction, round(any_value(q.e), 4) AS qc_extreme_area_fraction, round(any_value(q.m), 4) AS qc_missing_feature_fraction, round(any_value(q.i), 4) AS qc_include_fraction,
  any_value(images_completed) AS images_completed, round(any_value(mn), 4) AS median_cells_per_image, round(any_value(mc), 4) AS median_cell_coverage_fraction, round(any_value(lo), 4) AS area_qc_lower, round(any_value(hi), 4) AS area_qc_upper
FROM lineitem JOIN q USING (l_returnflag) JOIN j USING (l_returnflag) JOIN lim USING (l_returnflag) GROUP BY 1""",
    "select_best": "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS f1, max(o_totalprice) AS mean_matched_iou, min(o_totalprice) AS recall FROM orders GROUP BY 1 ORDER BY f1 DESC, mean_matched_iou DESC, recall DESC, o_orderpriority LIMIT 1",
    "lowest_k": "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15",
    "diverse_top_n": "WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice, o_orderkey) = 1 THEN 1 ELSE 2 END AS p FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p, o_totalprice, o_orderkey)::INT AS selection_rank FROM a) SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, selection_rank FROM b WHERE selection_rank <= 6",
    "even_spaced_pick": "WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS selection_rank, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), w AS (SELECT DISTINCT o_orderpriority, CASE WHEN i = 32 THEN n - 1 ELSE floor(i * ((n - 1) / 32.0::DOUBLE))::BIGINT END + 1 AS selection_rank FROM (SELECT DISTINCT o_orderpriority, n FROM r), range(33) t(i) WHERE n > 33) SELECT o_orderpriority, r.selection_rank, o_orderkey FROM r WHERE n <= 33 OR EXISTS (SELECT 1 FROM w WHERE w.o_orderpriority = r.o_orderpriority AND w.selection_rank = r.selection_rank)",
    "capped_first_n": "WITH a AS (SELECT o_orderkey, o_orderpriority LIKE '5%' AS x, o_custkey % 3 = 0 AS f, coalesce(sum((o_custkey % 3 = 0)::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT o_orderkey, CASE WHEN x THEN 'annotation_file_not_found' WHEN b >= 20 THEN 'evaluation_limit_reached' WHEN f THEN 'evaluated' ELSE 'not_in_annotation_file' END AS status FROM a",
    "confusion": "WITH p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label END AS predicted FROM embeddings) SELECT label, " + ", ".join(f"count(*) FILTER (predicted = {i}) AS c{i}" for i in range(10)) + " FROM p GROUP BY label",
    "class_metrics": "WITH p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label END AS predicted FROM embeddings), c AS (SELECT l.label, (SELECT count(*) FROM p WHERE p.label = l.label) AS support, (SELECT count(*) FROM p WHERE p.predicted = l.label) AS predicted, (SELECT count(*) FROM p WHERE p.label = l.label AND p.predicted = l.label) AS tp FROM (SELECT DISTINCT label FROM p UNION SELECT DISTINCT predicted FROM p) l) SELECT label, round(coalesce(tp / nullif(predicted, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + predicted, 0)::DOUBLE, 0), 6) AS f1, support FROM c",
    "left_anti_missing": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')",
    "semi_member": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')",
    "leak_check": "SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0",
    "bootstrap_means": "WITH v AS (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderpriority, count(*) AS n_images, round(avg(v), 4) AS mean, true AS holds_mean, true AS is_interval FROM v GROUP BY 1",
    "group_counts": "SELECT o_orderpriority, count(DISTINCT o_orderpriority || '|' || o_custkey) AS n_groups, count(*) AS cells FROM orders GROUP BY 1",
    "polygon_points": "SELECT o_orderkey, i::INT AS point, (2 * i)::INT AS x, (2 * i + 1)::INT AS y FROM orders, range(5) t(i) WHERE 2 * i + 1 <= o_orderkey % 9",
    "first_occurrence": "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS label FROM orders",
} | records.ORACLES | experiments.ORACLES
