"""Queries of the parameter search, the validation of clusters and the classifier.

Where an operator draws random numbers, or fits, the query runs it on data whose outcome SQL can
state: clusters far apart, classes that don't overlap, counts that any draw keeps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..operators import cells, classifier, matching, phenotypes, search, stats, validation
from .common import rounded as _r
from .common import table


def tuning_split(spark, sf_dir):
    """Sizes of both sides; every id stands on one."""
    c = table(spark, sf_dir, "customer")
    split = search.tuning_split(c, "c_custkey")
    return split.join(c, "c_custkey").groupBy("split").agg(F.countDistinct("c_custkey").alias("images"), F.max("position").alias("last"))


def parameter_grid(spark, sf_dir):
    return search.grid(spark, [None, 15, 20], [-1.0, 0.0, 1.0], [0.2, 0.4, 0.6], [15])


def first_images(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return search.first_images(o, "o_orderkey", 7).unionByName(search.first_images(o.where("o_orderkey < 3"), "o_orderkey"))


def _formula(configs):
    """Scores that a formula gives, in the place of a model."""
    d = F.coalesce("diameter", F.lit(30))
    f1 = 1 - F.abs(d - 20) / 100 - F.abs(F.col("cellprob_threshold") - 0.5) / 10 - F.abs(F.col("flow_threshold") - 0.4) / 10
    return configs.withColumns({"f1": F.round(f1, 6), "mean_matched_iou": F.round(f1 / 2, 6), "recall": F.lit(0.5).cast("double")})


def two_stage_search(spark, sf_dir):
    """All thirteen configurations, and which is the best; both thresholds of the first stage tie, the first by id stands."""
    every, best = search.two_stage_search(spark, _formula, {"diameter": None, "min_size": 15}, [-1.0, 0.0, 1.0], [0.2, 0.4, 0.6], [15, 20, 25, 40])
    return every.select("stage", "config_id", "f1", (F.col("config_id") == best["config_id"]).alias("best"))


def _square_model():
    def run(item):
        a = np.zeros((12, 12), np.int64)
        n = int(item["diameter"])
        a[1 : 1 + n, 1 : 1 + n] = 5
        return a

    return run


def configuration_scores(spark, sf_dir):
    """Squares of the configuration's diameter against squares of 1 + nation % 6 pixels, one an image."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("image"), (F.col("n_nationkey") % 6 + 1).alias("side"))
    truth = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("side") * F.col("side") - 1))).select("image", (F.floor(F.col("k") / F.col("side")) + 1).cast("int").alias("row"), (F.col("k") % F.col("side") + 1).cast("int").alias("col"), F.lit(1).cast("long").alias("label"))
    _, totals = search.score_configurations(n.select("image"), truth, search.grid(spark, [2, 4], [0.0], [0.4], [15]), _square_model)
    return _r(totals.select("config_id", "images", "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1", "mean_matched_iou"))


def held_out_comparison(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("f1"), F.count("*").alias("images"))
    pick = lambda x: o.where(F.col("o_orderstatus") == x).select("f1", "images")
    return _r(search.held_out_comparison(pick("F"), pick("O")), 4)


def hardest_image(spark, sf_dir):
    return search.hardest_image(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_totalprice").alias("f1")))


def match_failures(spark, sf_dir):
    """Objects with their best match, the ones that fail, and objects that nothing was matched for."""
    o = table(spark, sf_dir, "orders")
    best = o.where("o_orderkey % 4 > 0").select(F.lit("x").alias("image"), F.col("o_orderkey").alias("gt_label"), (F.col("o_custkey") + 1).alias("best_pred_label"), (F.col("o_custkey") % 10 / 10).alias("best_iou")).withColumn("matched", F.col("best_iou") >= 0.5)
    every = matching.with_best_match(o.select(F.lit("x").alias("image"), F.col("o_orderkey").alias("label")), best)
    failed = matching.failures(best).select(F.col("gt_label").alias("label"), F.lit(True).alias("failed"))
    return _r(every.join(failed, "label", "left").select("label", "best_pred_label", "best_iou", "matched", "segmentation_success", F.coalesce("failed", F.lit(False)).alias("failed")))


def iou_summary(spark, sf_dir):
    return _r(matching.iou_summary(table(spark, sf_dir, "lineitem").withColumn("iou", F.col("l_tax") * 10)))


def line_evaluation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count_if(F.col("l_tax") > 0.04).alias("true_positives"), F.count_if(F.col("l_tax") < 0.02).alias("false_positives"), F.count_if(F.col("l_discount") > 0.08).alias("false_negatives"), F.avg("l_tax").alias("mean_matched_iou"))
    return _r(matching.line_evaluation(li.withColumnsRenamed({"l_returnflag": "cell_line", "l_suppkey": "image"})))


def evaluation_statuses(spark, sf_dir):
    """How many images end in which status, with evaluation on and off."""
    o = table(spark, sf_dir, "orders")
    run = lambda on: stats.capped_status(o, "o_orderpriority", "o_orderkey", F.col("o_custkey") % 3 == 0, 20, ~F.col("o_orderpriority").startswith("5"), on)
    return run(True).unionByName(run(False)).groupBy("o_orderpriority", "status").agg(F.count("*").alias("images"))


def _far_apart(spark, sf_dir):
    """Three clusters far apart."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("kind"))
    return o.select("o_orderkey", "o_custkey", (F.col("kind") * 1000 + F.col("o_custkey") % 7).cast("double").alias("a"), ((F.col("kind") % 2) * 500 + F.col("o_orderkey") % 5).cast("double").alias("b"))


def kmeans_far_apart(spark, sf_dir):
    """Clusters numbered by the median of a."""
    return phenotypes.cluster(_far_apart(spark, sf_dir), ["a", "b"], 3, order_by="a").select("o_orderkey", "phenotype_cluster")


def pca_of_two(spark, sf_dir):
    """Two scaled columns: the ratios have a closed form."""
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    return _r(phenotypes.pca_variance(li, ["l_quantity", "l_extendedprice"]))


def silhouette(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"), (F.col("s_acctbal") > 4500).cast("int").alias("y"))
    return spark.createDataFrame([(round(phenotypes.silhouette(s, ["a", "b"], "y", "s_suppkey"), 6),)], "silhouette double")


def cluster_centres(spark, sf_dir):
    """Means and medians of each cluster."""
    li = table(spark, sf_dir, "lineitem")
    x = ["l_quantity", "l_discount"]
    return _r(validation.centres(li, "l_returnflag", x).join(validation.prototypes(li, "l_returnflag", x).withColumnsRenamed({c: f"median_{c}" for c in x}), "l_returnflag"))


def prototype_distance(spark, sf_dir):
    return _r(validation.prototype_distance(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_quantity", "prototype_distance"))


def representatives(spark, sf_dir):
    """Cells nearest to the prototypes; two images in three have both files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("image"), "o_orderstatus", "o_totalprice")
    files = o.select("image").distinct()
    out = validation.representatives(o, "o_orderstatus", ["o_totalprice"], files.where("image % 3 > 0"), files, order=[F.asc("o_orderkey")])
    return out.select("o_orderstatus", "o_orderkey", "selection_rank")


def bootstrap_weights(spark, sf_dir):
    """A resample has as many rows as the table, all from it, and leaves out about a third."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    got = validation.bootstrap_weights(o, ["o_orderkey"], 43).join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    share = F.count("*") / F.sum("weight")
    return got.agg(F.sum("weight").alias("drawn"), (F.count("*") == F.countDistinct("o_orderkey")).alias("once"), share.between(0.6, 0.67).alias("usual"))


def label_agreement(spark, sf_dir):
    """Raw labels in another order go back to the numbers of the nearest centres."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3 + 1).alias("label"), F.when(F.col("o_orderkey") % 5 == 0, 0).otherwise((F.col("o_orderkey") + 1) % 3).cast("int").alias("raw"))
    centres = np.array([[0.0, 0.0], [5.0, 5.0], [9.0, 0.0]])
    got, shift = validation.align_labels(o, "raw", centres[[2, 0, 1]] + 0.5, centres, [1, 2, 3])
    return _r(validation.agreement(got, "label", "aligned_label").withColumn("mean_centroid_shift", F.lit(shift)))


def stability_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bootstrap_iteration"), (F.col("o_totalprice") / 1e6).alias("adjusted_rand_index"), (F.col("o_custkey") / 7).alias("mean_centroid_shift"))
    return _r(validation.stability_summary(o))


def cluster_stability(spark, sf_dir):
    """Clusters far apart survive every refit; ten refits of twenty starts."""
    labelled = _far_apart(spark, sf_dir).withColumn("cluster", (F.col("o_orderkey") % 3 + 1).cast("int"))
    out = validation.stability(labelled, ["a", "b"], "cluster", ["o_orderkey"], refits=10)
    return out.select("bootstrap_iteration", "adjusted_rand_index", *(f"cluster_{k}_agreement" for k in (1, 2, 3)), (F.col("mean_centroid_shift") < 5).alias("small_shift"))


def _composition(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image"), (F.col("o_custkey") % 5 * 4.0).alias("elapsed_hours"), (F.col("o_orderkey") % 3).alias("cluster"))
    return cells.composition(o, ["image", "elapsed_hours"], "cluster")


def change_over_time(spark, sf_dir):
    """Means at both ends and their change; the interval holds the change."""
    out = validation.change_over_time(_composition(spark, sf_dir), "elapsed_hours", "cluster", "cluster_fraction")
    held = (F.col("bootstrap_ci_lower") < F.col("change_latest_minus_earliest")) & (F.col("change_latest_minus_earliest") < F.col("bootstrap_ci_upper"))
    return _r(out.withColumn("held", held).drop("bootstrap_ci_lower", "bootstrap_ci_upper"))


def time_ends(spark, sf_dir):
    low, high = validation.time_ends(_composition(spark, sf_dir), "elapsed_hours")
    return _composition(spark, sf_dir).where(F.col("elapsed_hours").isin(low, high)).select("image", "elapsed_hours", "cluster", "cells")


def correlation_order(spark, sf_dir):
    """Spearman's rho of pairs of columns, the strongest first."""
    li = table(spark, sf_dir, "lineitem")
    pairs = [("l_quantity", "l_extendedprice"), ("l_tax", "l_discount"), ("l_linenumber", "l_quantity")]
    each = [stats.spearman(li, a, b).select(F.lit(f"{a}~{b}").alias("pair"), "rho", "n") for a, b in pairs]
    return _r(stats.by_strength(each[0].unionByName(each[1]).unionByName(each[2])).limit(3))


def _cells_of_lines(spark, sf_dir, wells):
    c = table(spark, sf_dir, "customer")
    at = lambda prefix, m: F.concat(F.lit(prefix), (F.col("c_custkey") % m).cast("string"))
    out = c.select("c_custkey", F.col("c_mktsegment").alias("cell_line"), at("img", 40).alias("image"), at("W", wells).alias("well"), F.lit(1).alias("location"), F.col("c_acctbal"))
    turn = F.array_position(F.lit(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]), F.col("cell_line")) * 2 * F.pi() / 5
    return out.withColumns({"x": 100 * F.cos(turn) + F.col("c_custkey") % 9, "y": 100 * F.sin(turn) + F.col("c_custkey") % 11})


def split_groups(spark, sf_dir):
    """Fields of view where each class has two, and images where a class has one field only."""
    out = []
    for wells in (6, 1):
        _, strategy, found = classifier.split_groups(_cells_of_lines(spark, sf_dir, wells))
        out += [(wells, strategy, k, v) for k, v in found.items()]
    return spark.createDataFrame(out, "wells int, strategy string, cell_line string, n_groups long")


def _validated(spark, sf_dir, **more):
    grouped, _, _ = classifier.split_groups(_cells_of_lines(spark, sf_dir, 6))
    return grouped, classifier.cross_validate(grouped, ["x", "y"], "cell_line", ["c_custkey"], **more)


def classifier_cv(spark, sf_dir):
    """Both models, five folds, classes that do not overlap: every fold is right, and each cell is held out once a model."""
    _, v = _validated(spark, sf_dir)
    return _r(v.fold_metrics.groupBy("model").agg(F.count("*").alias("folds"), F.sum("held_out_cells").alias("held_out"), F.sum("held_out_groups").alias("groups"), *(F.min(m).alias(m) for m in classifier.METRICS)))


def out_of_fold(spark, sf_dir):
    """The prediction table of the logistic model, a probability for every class."""
    grouped, v = _validated(spark, sf_dir, models=("logistic_regression",))
    p = [c for c in v.predictions.columns if c.startswith("probability_")]
    sure = F.greatest(*p) > 0.5
    return v.predictions.select("c_custkey", "model", "cell_line", "predicted_cell_line", "correct", sure.alias("sure"), F.round(sum((F.col(c) for c in p), F.lit(0.0)), 6).alias("total"))


def training_record(spark, sf_dir):
    """A record over a fixed fold."""
    c = _cells_of_lines(spark, sf_dir, 6).withColumn("split_group", E.group_key("cell_line", "well"))
    fold = F.col("well").isin("W0", "W1")
    return classifier.training_record(c.where(~fold), c.where(fold), "cell_line", 7, 1)


def final_model(spark, sf_dir):
    """The final fit takes as many cells of each class, and knows all classes."""
    grouped, _, _ = classifier.split_groups(_cells_of_lines(spark, sf_dir, 6))
    model, used = classifier.final_fit(grouped, ["x", "y"], "cell_line", ["c_custkey"], "logistic_regression")
    got = classifier.predict(model, grouped, "cell_line", sorted(r[0] for r in grouped.select("cell_line").distinct().collect()))
    return used.groupBy("cell_line").agg(F.count("*").alias("cells")).join(got.groupBy("cell_line").agg(F.avg(F.col("correct").cast("double")).alias("correct")), "cell_line")


def balanced_sample(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    got = stats.balanced_sample(c, "c_mktsegment", 5000, 42, "c_custkey")
    return got.groupBy("c_mktsegment").agg(F.count("*").alias("cells"), F.countDistinct("c_custkey").alias("ids"))


def _fold_table(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 97 / 97).alias("accuracy"), (F.col("o_orderkey") % 89 / 89).alias("balanced_accuracy"), (F.col("o_totalprice") / 1e6).alias("macro_f1"))


def model_summary(spark, sf_dir):
    """Means and sample deviations of each model, and the best."""
    s = classifier.model_summary(_fold_table(spark, sf_dir))
    best = classifier.best_model(s).first()["model"]
    return _r(s).withColumn("best", F.col("model") == best)


def importance_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("feature"), (F.col("o_totalprice") / 1e6).alias("importance"))
    return _r(classifier.importance_summary(o))


def confusion_shares(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("predicted", F.when(F.col("vec_id") % 3 == 0, F.lit(1)).otherwise(F.col("label")).cast("int"))
    out = stats.normalised_confusion(stats.confusion(e, "label", "predicted", list(range(10))), "label", list(range(10)))
    return _r(out.select("label", *(F.col(str(i)).alias(f"c{i}") for i in range(10))))


def pooled_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("model"), "label", F.when(F.col("vec_id") % 3 == 0, F.lit(1)).otherwise(F.col("label")).cast("int").alias("predicted_cell_line"))
    return _r(classifier.pooled_metrics(e, "m", "label")[1].select("accuracy", "balanced_accuracy", "macro_f1"))


QUERIES = {f.__name__: f for f in (
    tuning_split, parameter_grid, first_images, two_stage_search, configuration_scores, held_out_comparison, hardest_image, match_failures, iou_summary, line_evaluation, evaluation_statuses, kmeans_far_apart, pca_of_two, silhouette,
    cluster_centres, prototype_distance, representatives, bootstrap_weights, label_agreement, stability_summary, cluster_stability, change_over_time, time_ends, correlation_order, split_groups, classifier_cv, out_of_fold, training_record, final_model,
    balanced_sample, model_summary, importance_summary, confusion_shares, pooled_metrics,
)}

_CONFIG = "'diameter_' || coalesce(d::VARCHAR, 'native') || '__cellprob_' || format('{:+.1f}', p) || '__flow_' || format('{:.1f}', f) || '__minsize_15'"
_PREDICTED = "p AS (SELECT label, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label END AS predicted FROM embeddings)"
_LINES = "c AS (SELECT c_custkey, c_mktsegment AS cell_line, 'img' || (c_custkey % 40) AS image, 'W' || (c_custkey % 6) AS well FROM customer)"
_PARTS = "n AS (SELECT o_custkey AS image, o_custkey % 5 * 4.0::DOUBLE AS elapsed_hours, o_orderkey % 3 AS cluster, count(*) AS k FROM orders GROUP BY ALL), comp AS (SELECT g.image, g.elapsed_hours, g.cluster, coalesce(k, 0) AS cells, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY g.image)::DOUBLE AS x FROM (SELECT * FROM (SELECT DISTINCT image, elapsed_hours FROM n), (SELECT DISTINCT cluster FROM n)) g LEFT JOIN n USING (image, cluster))"


def _rank_pair(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"SELECT '{a}~{b}' AS pair, round(corr(x, y), 6) AS rho, count(*) AS n FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM lineitem)"


ORACLES = {
    "tuning_split": "WITH n AS (SELECT count(*) AS n, round_even(count(*) * 0.6, 0)::BIGINT AS t FROM customer) SELECT 'tuning' AS split, t AS images, (t - 1)::INT AS last FROM n UNION ALL SELECT 'validation', n - t, (n - 1)::INT FROM n",
    "parameter_grid": f"SELECT {_CONFIG} AS config_id, d AS diameter, p AS cellprob_threshold, f AS flow_threshold, 15 AS min_size FROM (VALUES (NULL), (15), (20)) a(d), (VALUES (-1.0::DOUBLE), (0.0), (1.0)) b(p), (VALUES (0.2::DOUBLE), (0.4), (0.6)) c(f)",
    "first_images": "(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7) UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 3",
    "two_stage_search": f"""WITH c AS (SELECT 1 AS stage, NULL::INT AS d, p, f FROM (VALUES (-1.0::DOUBLE), (0.0), (1.0)) b(p), (VALUES (0.2::DOUBLE), (0.4), (0.6)) g(f) UNION ALL SELECT 2, d, 0.0::DOUBLE, 0.4::DOUBLE FROM (VALUES (15), (20), (25), (40)) a(d)),
s AS (SELECT stage, {_CONFIG} AS config_id, round(1 - abs(coalesce(d, 30) - 20) / 100::DOUBLE - abs(p - 0.5::DOUBLE) / 10 - abs(f - 0.4::DOUBLE) / 10, 6) AS f1 FROM c)
SELECT stage, config_id, f1, config_id = (SELECT config_id FROM s ORDER BY f1 DESC, stage, config_id LIMIT 1) AS best FROM s""",
    "configuration_scores": f"""WITH c AS (SELECT d, 0.0::DOUBLE AS p, 0.4::DOUBLE AS f FROM (VALUES (2), (4)) t(d)), x AS (SELECT {_CONFIG} AS config_id, least(d, s) ** 2 / greatest(d, s) ** 2::DOUBLE AS iou FROM c, (SELECT n_nationkey % 6 + 1 AS s FROM nation)),
t AS (SELECT config_id, count(*) AS images, count(*) FILTER (iou >= 0.5) AS true_positives, count(*) FILTER (iou < 0.5) AS false_positives, avg(iou) FILTER (iou >= 0.5) AS m FROM x GROUP BY 1)
SELECT config_id, images, true_positives, false_positives, false_positives AS false_negatives, round(true_positives / images::DOUBLE, 6) AS precision, round(true_positives / images::DOUBLE, 6) AS recall, round(true_positives / images::DOUBLE, 6) AS f1, round(m, 6) AS mean_matched_iou FROM t""",
    "held_out_comparison": "WITH s AS (SELECT o_orderstatus, avg(o_totalprice) AS f1, count(*) AS images FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1) SELECT round(f1, 4) AS f1, images, CASE o_orderstatus WHEN 'F' THEN 'validation_baseline' ELSE 'validation_optimized' END AS split, CASE WHEN (SELECT f1 FROM s WHERE o_orderstatus = 'O') > (SELECT f1 FROM s WHERE o_orderstatus = 'F') THEN 'improved' ELSE 'did_not_generalise' END AS verdict FROM s",
    "hardest_image": "SELECT o_orderkey AS image, o_totalprice AS f1 FROM orders ORDER BY f1, image LIMIT 1",
    "match_failures": "SELECT o_orderkey AS label, CASE WHEN o_orderkey % 4 > 0 THEN o_custkey + 1 ELSE 0 END AS best_pred_label, CASE WHEN o_orderkey % 4 > 0 THEN round(o_custkey % 10 / 10::DOUBLE, 6) ELSE 0.0::DOUBLE END AS best_iou, o_orderkey % 4 > 0 AND o_custkey % 10 >= 5 AS matched, (o_orderkey % 4 > 0 AND o_custkey % 10 >= 5)::INT AS segmentation_success, o_orderkey % 4 > 0 AND o_custkey % 10 < 5 AS failed FROM orders",
    "iou_summary": "SELECT count(*) AS objects, round(avg(l_tax * 10), 6) AS mean_iou, round(median(l_tax * 10), 6) AS median_iou FROM lineitem",
    "line_evaluation": """WITH i AS (SELECT l_returnflag, l_suppkey, count(*) FILTER (l_tax > 0.04) AS tp, count(*) FILTER (l_tax < 0.02) AS fp, count(*) FILTER (l_discount > 0.08) AS fn, avg(l_tax) AS m FROM lineitem GROUP BY ALL), s AS (SELECT l_returnflag AS cell_line, count(*) AS evaluation_images, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(m) AS m FROM i GROUP BY 1)
SELECT cell_line, evaluation_images, tp AS micro_true_positives, fp AS micro_false_positives, fn AS micro_false_negatives, round(m, 6) AS mean_matched_iou, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM s""",
    "evaluation_statuses": """WITH a AS (SELECT o_orderpriority, o_orderpriority LIKE '5%' AS x, o_custkey % 3 = 0 AS f, coalesce(sum((o_custkey % 3 = 0)::INT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders),
s AS (SELECT o_orderpriority, CASE WHEN x THEN 'annotation_file_not_found' WHEN b >= 20 THEN 'evaluation_limit_reached' WHEN f THEN 'evaluated' ELSE 'not_in_annotation_file' END AS status FROM a UNION ALL SELECT o_orderpriority, 'evaluation_disabled' FROM a) SELECT o_orderpriority, status, count(*) AS images FROM s GROUP BY ALL""",
    "kmeans_far_apart": "SELECT o_orderkey, (o_orderkey % 3 + 1)::INT AS phenotype_cluster FROM orders",
    "pca_of_two": """WITH q AS (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS j FROM lineitem), v AS (SELECT var_samp(l_quantity) / any_value(i * i) AS a, var_samp(l_extendedprice) / any_value(j * j) AS b, covar_samp(l_quantity, l_extendedprice) / any_value(i * j) AS c FROM lineitem, q),
e AS (SELECT ((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c)) / (a + b) AS r FROM v) SELECT 'PC1' AS principal_component, round(r, 6) AS explained_variance_ratio, round(r, 6) AS cumulative_explained_variance FROM e UNION ALL SELECT 'PC2', round(1 - r, 6), 1.0::DOUBLE FROM e""",
    "silhouette": """WITH s AS (SELECT s_suppkey AS k, s_acctbal AS a, s_nationkey::DOUBLE AS b, (s_acctbal > 4500)::INT AS y FROM supplier), d AS (SELECT p.k, p.y = q.y AS own, sum(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2)) AS t, count(*) AS n FROM s p, s q GROUP BY ALL),
m AS (SELECT k, max(CASE WHEN own THEN CASE WHEN n > 1 THEN t / (n - 1) END END) AS a, max(CASE WHEN NOT own THEN t / n END) AS b FROM d GROUP BY k) SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""",
    "cluster_centres": "SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(median(l_quantity), 6) AS median_l_quantity, round(median(l_discount), 6) AS median_l_discount FROM lineitem GROUP BY 1",
    "prototype_distance": "WITH m AS (SELECT l_returnflag, median(l_quantity) AS q, median(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_quantity, round(sqrt((l_quantity - q) ** 2 + (l_linenumber - n) ** 2), 6) AS prototype_distance FROM lineitem JOIN m USING (l_returnflag)",
    "representatives": """WITH m AS (SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY 1), d AS (SELECT o_orderstatus, o_orderkey, o_custkey, abs(o_totalprice - m) AS d FROM orders JOIN m USING (o_orderstatus) WHERE o_custkey % 3 > 0),
a AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY d, o_orderkey) = 1 THEN 1 ELSE 2 END AS p FROM d), b AS (SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY p, d, o_orderkey))::INT AS selection_rank FROM a) SELECT * FROM b WHERE selection_rank <= 6""",
    "bootstrap_weights": "SELECT count(*)::DOUBLE AS drawn, true AS once, true AS usual FROM orders",
    "label_agreement": "WITH o AS (SELECT o_orderkey % 3 + 1 AS label, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey + 1) % 3 END AS raw FROM orders) SELECT label, round(avg((label = CASE raw WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::INT), 6) AS agreement, round(sqrt(0.5::DOUBLE), 6) AS mean_centroid_shift FROM o GROUP BY 1",
    "stability_summary": " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({x}), 6) AS mean, round(median({x}), 6) AS median, round(quantile_cont({x}, 0.025), 6) AS ci_lower, round(quantile_cont({x}, 0.975), 6) AS ci_upper FROM orders" for m, x in (("adjusted_rand_index", "o_totalprice / 1e6"), ("mean_centroid_shift", "o_custkey / 7::DOUBLE"))),
    "cluster_stability": "SELECT i AS bootstrap_iteration, 1.0::DOUBLE AS adjusted_rand_index, 1.0::DOUBLE AS cluster_1_agreement, 1.0::DOUBLE AS cluster_2_agreement, 1.0::DOUBLE AS cluster_3_agreement, true AS small_shift FROM (SELECT unnest(range(1, 11))::INT AS i)",
    "change_over_time": f"WITH {_PARTS}, e AS (SELECT min(elapsed_hours) AS a, max(elapsed_hours) AS b FROM comp), m AS (SELECT cluster, any_value(a) AS a, any_value(b) AS b, avg(x) FILTER (elapsed_hours = a) AS x, avg(x) FILTER (elapsed_hours = b) AS y, count(*) FILTER (elapsed_hours = a) AS n, count(*) FILTER (elapsed_hours = b) AS k FROM comp, e GROUP BY 1) SELECT cluster, a AS earliest_time_hours, b AS latest_time_hours, round(x, 6) AS mean_fraction_earliest, round(y, 6) AS mean_fraction_latest, round(y - x, 6) AS change_latest_minus_earliest, n AS n_images_earliest, k AS n_images_latest, true AS held FROM m",
    "time_ends": f"WITH {_PARTS} SELECT image, elapsed_hours, cluster, cells FROM comp WHERE elapsed_hours = (SELECT min(elapsed_hours) FROM comp) OR elapsed_hours = (SELECT max(elapsed_hours) FROM comp)",
    "correlation_order": " UNION ALL ".join(_rank_pair(a, b) for a, b in (("l_quantity", "l_extendedprice"), ("l_tax", "l_discount"), ("l_linenumber", "l_quantity"))),
    "split_groups": f"WITH {_LINES} SELECT 6 AS wells, 'cell_line + well + location' AS strategy, cell_line, count(DISTINCT well) AS n_groups FROM c GROUP BY 3 UNION ALL SELECT 1, 'cell_line + image', cell_line, count(DISTINCT image) FROM c GROUP BY 3",
    "classifier_cv": f"WITH {_LINES}, n AS (SELECT count(*) AS n, count(DISTINCT cell_line || well) AS g, least(5, min(k)) AS f FROM c, (SELECT min(k) AS k FROM (SELECT count(DISTINCT well) AS k FROM c GROUP BY cell_line))) SELECT m AS model, f AS folds, n AS held_out, g AS groups, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS balanced_accuracy, 1.0::DOUBLE AS macro_f1 FROM n, (VALUES ('logistic_regression'), ('random_forest')) t(m)",
    "out_of_fold": "SELECT c_custkey, 'logistic_regression' AS model, c_mktsegment AS cell_line, c_mktsegment AS predicted_cell_line, true AS correct, true AS sure, 1.0::DOUBLE AS total FROM customer",
    "training_record": f"WITH {_LINES} SELECT 1 AS fold, cell_line, count(*) FILTER (well NOT IN ('W0', 'W1')) AS available_training_cells, 7::BIGINT AS balanced_training_cells, count(*) FILTER (well IN ('W0', 'W1')) AS held_out_cells, count(DISTINCT well) FILTER (well IN ('W0', 'W1')) AS held_out_groups FROM c GROUP BY 2",
    "final_model": "SELECT c_mktsegment AS cell_line, least(5000, (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))) AS cells, 1.0::DOUBLE AS correct FROM customer GROUP BY 1",
    "balanced_sample": "WITH n AS (SELECT least(5000, min(n)) AS n FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) SELECT c_mktsegment, any_value(n) AS cells, any_value(n) AS ids FROM customer, n GROUP BY 1",
    "model_summary": "WITH s AS (SELECT o_orderpriority AS model, avg(o_custkey % 97 / 97::DOUBLE) AS a, stddev_samp(o_custkey % 97 / 97::DOUBLE) AS b, avg(o_orderkey % 89 / 89::DOUBLE) AS c, stddev_samp(o_orderkey % 89 / 89::DOUBLE) AS d, avg(o_totalprice / 1e6) AS e, stddev_samp(o_totalprice / 1e6) AS f FROM orders GROUP BY 1) SELECT model, round(a, 6) AS accuracy_mean, round(b, 6) AS accuracy_std, round(c, 6) AS balanced_accuracy_mean, round(d, 6) AS balanced_accuracy_std, round(e, 6) AS macro_f1_mean, round(f, 6) AS macro_f1_std, e = (SELECT max(e) FROM s) AS best FROM s",
    "importance_summary": "SELECT o_orderpriority AS feature, round(avg(o_totalprice / 1e6), 6) AS mean_importance, round(stddev_samp(o_totalprice / 1e6), 6) AS std_importance FROM orders GROUP BY 1",
    "confusion_shares": f"WITH {_PREDICTED} SELECT label, " + ", ".join(f"round(count(*) FILTER (predicted = {i}) / count(*)::DOUBLE, 6) AS c{i}" for i in range(10)) + " FROM p GROUP BY label",
    "pooled_metrics": f"WITH {_PREDICTED}, c AS (SELECT l AS label, (SELECT count(*) FROM p WHERE label = l) AS s, (SELECT count(*) FROM p WHERE predicted = l) AS q, (SELECT count(*) FROM p WHERE label = l AND predicted = l) AS t FROM (SELECT DISTINCT label AS l FROM p UNION SELECT DISTINCT predicted FROM p)) SELECT round((SELECT avg((label = predicted)::INT) FROM p), 6) AS accuracy, round(avg(t / s::DOUBLE) FILTER (s > 0), 6) AS balanced_accuracy, round(avg(2 * t / (s + q)::DOUBLE), 6) AS macro_f1 FROM c",
}
