import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.operators import classifier, phenotypes, search, stats, validation
from cellspark.sources import images


def test_split_is_seeded_and_needs_four(spark):
    ids = spark.createDataFrame([(i * 3,) for i in range(11)] * 2, "image_id long")
    got = [(r.image_id, r.split) for r in search.tuning_split(ids).orderBy("position").collect()]
    want = np.arange(0, 33, 3)
    np.random.default_rng(42).shuffle(want)
    assert [g[0] for g in got] == want.tolist() and [g[1] for g in got] == ["tuning"] * 7 + ["validation"] * 4
    assert search.tuning_split(ids, most=4).count() == 4
    with pytest.raises(ValueError):
        search.tuning_split(ids.where("image_id < 9"))


def test_comparison_ties_and_losses(spark):
    f = lambda x: spark.createDataFrame([(x,)], "f1 double")
    said = [search.held_out_comparison(f(0.5), f(x)).first().verdict for x in (0.6, 0.5, 0.4)]
    assert said == ["improved", "tied", "did_not_generalise"]


def blobs(spark, n=120):
    r = np.random.default_rng(1)
    rows = [(i, f"img{i % 12}", "abc"[i % 3], *(float(x) for x in r.normal((0, 0) if i % 3 == 0 else (9, 0) if i % 3 == 1 else (0, 9), 0.4))) for i in range(n)]
    return spark.createDataFrame(rows, "cell_id int, image string, cell_line string, x double, y double")


def test_number_of_clusters_and_their_order(spark):
    df = blobs(spark, 60).withColumn("area", F.col("x") + 2 * F.col("y"))
    k, found = phenotypes.select_k(df, ["x", "y"], "cell_id", "area", most=4, restarts=2)
    assert k == 3 and [x[0] for x in found] == [2, 3, 4] and all(a[2] >= b[2] for a, b in zip(found, found[1:]))
    medians = [r.m for r in phenotypes.cluster(df, ["x", "y"], 3, 2).groupBy("phenotype_cluster").agg(F.median("area").alias("m")).orderBy("phenotype_cluster").collect()]
    assert medians == sorted(medians)
    with pytest.raises(ValueError):
        phenotypes.select_k(df.limit(2), ["x", "y"], "cell_id", "area")


def test_groups_fall_back_to_images(spark):
    df = blobs(spark).withColumns({"well": F.lit("A1"), "location": F.lit(1)})
    assert classifier.split_groups(df)[1] == "cell_line + image"
    assert classifier.split_groups(df.withColumn("location", F.col("cell_id") % 2))[1] == "cell_line + well + location"
    assert classifier.split_groups(df.withColumn("location", F.when(F.col("cell_id") > 0, F.col("cell_id") % 2)))[1] == "cell_line + image"
    with pytest.raises(ValueError):
        classifier.split_groups(df.withColumn("image", F.lit("one")))


def test_validation_tables_and_the_saved_model(spark, tmp_path):
    df, _, _ = classifier.split_groups(blobs(spark).withColumn("y", F.when(F.col("cell_id") != 5, F.col("y"))))
    v = classifier.cross_validate(df, ["x", "y"], "cell_line", ["cell_id"], trees=5)
    folds = {(r.fold, r.model): r for r in v.fold_metrics.collect()}
    assert len(folds) == 8  # four images of each class
    assert all(r.macro_f1 == 1.0 for (_, name), r in folds.items() if name == "logistic_regression") and all(r.macro_f1 > 0.8 for r in folds.values())
    assert v.predictions.count() == 2 * 119 and v.predictions.where("model = 'logistic_regression' and not correct").count() == 0
    assert v.importances.groupBy("fold").agg(F.sum("importance").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    record = v.training.where("cell_line = 'a'").agg(F.sum("held_out_cells"), F.sum("held_out_groups")).first()
    assert tuple(record) == (40, 4)
    best = classifier.best_model(classifier.model_summary(v.fold_metrics)).first()
    assert best.model == "logistic_regression" and best.accuracy_std == 0.0
    assert {r.feature for r in classifier.importance_summary(v.importances).collect()} == {"x", "y"}
    model, used = classifier.final_fit(df, ["x", "y"], "cell_line", ["cell_id"], "logistic_regression")
    assert used.groupBy("cell_line").count().select("count").distinct().count() == 1
    images.save_model(model, str(tmp_path / "m"), {"columns": ["x", "y"], "classes": ["a", "b", "c"]})
    again, about = images.load_model(str(tmp_path / "m"))
    got = classifier.predict(again, df.where("y is not null"), "cell_line", ["a", "b", "c", "unseen"])
    assert about["classes"] == ["a", "b", "c"] and got.where("not correct or probability_unseen <> 0").count() == 0


def test_scaling_sees_training_rows_only(spark):
    train, test = blobs(spark).where("cell_id < 60"), blobs(spark).where("cell_id >= 60").withColumn("x", F.col("x") + 1e6)
    model = classifier.fit(train, ["x", "y"], "cell_line", ["a", "b", "c"], "logistic_regression", 1)
    q = np.quantile([r.x for r in train.collect()], [0.25, 0.5, 0.75])
    got = model.transform(test).select("x", "x_scaled").first()
    assert got.x_scaled == pytest.approx((got.x - q[1]) / (q[2] - q[0]))


def test_an_empty_class_is_an_error(spark):
    with pytest.raises(ValueError, match="d"):
        stats.balanced_sample(blobs(spark), "cell_line", 9, 1, "cell_id", classes=["a", "d"])


def test_bootstrap_weights_are_a_resample(spark):
    df = blobs(spark)
    a, b = (validation.bootstrap_weights(df, ["cell_id"], s).select("cell_id", "weight").orderBy("cell_id").collect() for s in (1, 2))
    assert sum(r.weight for r in a) == sum(r.weight for r in b) == 120 and a != b and len({r.cell_id for r in a}) == len(a) < 100
    assert a == validation.bootstrap_weights(df.repartition(5), ["cell_id"], 1).select("cell_id", "weight").orderBy("cell_id").collect()


def test_times_need_two_ends(spark):
    one = spark.createDataFrame([(1.0, 1, 0.5), (1.0, 1, 0.4)], "t double, c int, v double")
    with pytest.raises(ValueError):
        validation.change_over_time(one, "t", "c", "v")


def test_folds_are_predicted_once_and_fitted_in_few_tasks(spark, monkeypatch):
    seen, parts, predict, fit = spark.sparkContext.accumulator(0), [], classifier.predict, classifier.fit

    def counted(*given):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        got = predict(*given)
        return got.mapInArrow(count, got.schema)

    def watched(train, *more):
        parts.append(train.rdd.getNumPartitions())
        return fit(train, *more)

    monkeypatch.setattr(classifier, "predict", counted)
    monkeypatch.setattr(classifier, "fit", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df, _, _ = classifier.split_groups(blobs(spark))
        v = classifier.cross_validate(df, ["x", "y"], "cell_line", ["cell_id"], folds=2, models=("logistic_regression",))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen.value == 120 and parts == [3, 3]
    assert v.fold_metrics.agg(F.sum("held_out_cells"), F.sum("held_out_groups"), F.min("accuracy")).first()[:] == (120, 12, 1.0)


def test_a_balanced_sample_ranks_few_rows(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") < 20, "a").when(F.col("id") < 40, None).otherwise("b").alias("k"), F.lit(7).alias("same"))
    h = F.xxhash64("id", F.lit(3))
    rows = sorted((r.h, r.id, str(r.k)) for r in df.select("id", "k", h.alias("h")).collect())
    want = {(k, i) for k in ("a", "b", "None") for _, i, _ in [r for r in rows if r[2] == k][:5]}
    assert {(str(r.k), r.id) for r in stats.balanced_sample(df, "k", 5, 3, "id").collect()} == want
    assert 60 < df.where(stats.low_hashes(h, "k", {"a": 1.5, "b": 0.03})).count() < 300  # of 4,000
    # ids that repeat: all rows of a class may hash high, or low
    for seed in range(4):
        got = stats.balanced_sample(df, "k", 5, seed, "same").groupBy("k").count().collect()
        assert sorted((str(r[0]), r[1]) for r in got) == [("None", 5), ("a", 5), ("b", 5)]
