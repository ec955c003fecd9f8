import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellspark.functions import expressions as E
from cellspark.operators import cells, matching, phenotypes, stats
from cellspark.sources import images


def test_overlap_threshold_and_background(spark):
    gt = [(r, c, 1) for r in range(3) for c in range(3)] + [(r, c, 2) for r in (5, 6) for c in (5, 6)]
    pred = {(r, c + 1): 7 for r in range(3) for c in range(3)} | {(5, 5): 300, (5, 6): 300}
    rows = [("a", g, pred.get((r, c), 0)) for r, c, g in gt] + [("a", 0, k) for (r, c), k in pred.items() if (r, c) not in {(x, y) for x, y, _ in gt}]
    pairs = spark.createDataFrame(rows, "image string, gt_label long, pred_label long")
    got = {(r.gt_label, r.pred_label): (r.n, round(r.iou, 6)) for r in matching.overlaps(pairs).collect()}
    assert got == {(1, 7): (6, 0.5), (2, 300): (2, 0.5)}
    best = matching.best_match(matching.overlaps(pairs), pairs.where("gt_label > 0"), "gt_label", "pred_label").collect()
    assert all(r.matched for r in best)


def test_best_match_of_nothing_is_label_one(spark):
    pairs = spark.createDataFrame([("a", 1, 0), ("a", 0, 2)], "image string, gt_label long, pred_label long")
    r = matching.best_match(matching.overlaps(pairs), pairs.where("gt_label > 0"), "gt_label", "pred_label").first()
    assert (r.best_pred_label, r.best_iou, r.matched) == (1, 0.0, False)


def test_assignment_beats_greedy(spark):
    ious = spark.createDataFrame([("a", 1, 1, 0.60), ("a", 1, 2, 0.55), ("a", 2, 1, 0.58)], "image string, gt_label long, pred_label long, iou double")
    assert {(r.gt_label, r.pred_label) for r in matching.assign(ious).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("seed", range(30))
def test_assignment_is_optimal(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 6, 2).tolist()
    c = r.random((n, m)).round(1)
    # with costs far below none, as many as can be are assigned
    got = sum(c[i, j] for i, j in enumerate(matching.sparse_assignment([[(k, x - 9) for k, x in enumerate(row)] for row in c.tolist()])) if j is not None)
    small, large = min(n, m), max(n, m)
    d = c if n <= m else c.T
    assert math.isclose(got, min(sum(d[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), small)), abs_tol=1e-9)


def test_two_mean_ious(spark):
    rows = [("L", "x", 1, 0, 0, 0.9, 0.9), ("L", "y", 9, 1, 1, 5.4, 0.6)]
    df = spark.createDataFrame(rows, "cell_line string, image string, true_positives long, false_positives long, false_negatives long, matched_iou_sum double, mean_matched_iou double")
    assert matching.micro_summary(df).first().mean_matched_iou == pytest.approx(0.63)
    assert matching.line_evaluation(df).first().mean_matched_iou == pytest.approx(0.75)


def test_file_names(spark):
    names = ["A172_Phase_D7_1_02d04h00m_3.tif", "A172_Phase_d7_1_02d04h00m_3.tif", "A172_Phase_D7_1_2d4h0m_3.tif", "A172_Phase_D12_1_100d04h30m_3.tif", "x.png", "A172_Phase_D7_1_02d04h00m_3.tiff", "A172_Phase_7D_1_02d04h00m_3.tif", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, image string")
    rows = E.add_filename_metadata(df).orderBy("i").collect()
    assert [(r.cell_line, r.well, r.location, r.elapsed_hours, r.crop) for r in rows[:4]] == [("A172", "D7", 1, 52.0, 3), ("A172", "d7", 1, 52.0, 3), ("A172", "D7", 1, 52.0, 3), ("A172", "D12", 1, 2404.5, 3)]
    assert all(r.cell_line is None and r.elapsed_hours is None for r in rows[4:])
    forced = E.metadata_for_line(df, F.lit("BV2")).orderBy("i").collect()
    assert {r.cell_line for r in forced} == {"BV2"} and forced[4].well is None


def test_quality_flags_with_nan_null_and_text_booleans(spark):
    rows = [(1, 10.0, " YES ", 1.0), (2, float("nan"), "False", 1.0), (3, None, None, 1.0), (4, 11.0, "0", float("inf")), (5, 12.0, "no", 2.0)]
    df = spark.createDataFrame(rows, "id int, area double, border string, f double")
    out = {r.id: r.qc_exclusion_reason for r in cells.qc_flags(df, cells.area_limits(df, "area", 0.0, 1.0), "area", ["area", "f"], F.col("border")).collect()}
    assert out == {1: "image_border", 2: "missing_feature", 3: "missing_feature", 4: "missing_feature", 5: "included"}


def test_crowding_edges(spark):
    pts = [("a", 1, 0.0, 0.0), ("a", 2, 0.0, 50.0), ("a", 3, 0.0, 50.0), ("a", 4, 500.0, 500.0), ("b", 1, 3.0, 3.0)]
    df = spark.createDataFrame(pts, "image string, cell_id long, y double, x double")
    got = {(r.image, r.cell_id): (r.neighbours_within_50px, r.nearest_neighbour_distance) for r in cells.crowding(df, "image", "cell_id", "y", "x").collect()}
    assert got[("a", 1)] == (2, 50.0) and got[("a", 2)] == (2, 0.0) and got[("b", 1)] == (0, None)
    assert got[("a", 4)][0] == 0 and got[("a", 4)][1] == pytest.approx(math.hypot(500, 450))


def test_tied_quartiles_merge(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 0, 0, 0, 1, 2, 3)], "v double")
    bins = [r.q for r in cells.quartile_bins(df, "v", "q", ["a", "b", "c", "d"]).orderBy("v").collect()]
    assert bins[:5] == ["a"] * 5 and bins[-1] == max(bins) and None not in bins


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r.v_scaled for r in stats.robust_scale(df, ["v"]).collect()] == [0.0, 0.0]


def test_region_shapes():
    assert cells.perimeter(np.ones((3, 3), bool)) == pytest.approx(8.0)
    r, c = np.nonzero(np.ones((4, 6)))
    assert cells.hull_area(r, c) == 24
    shapes = {"plus": ([0, 1, 1, 1, 2], [1, 0, 1, 2, 1], 5), "corner": ([0, 1, 2, 2, 2], [0, 0, 0, 1, 2], 6), "slant": ([0, 1, 2], [0, 1, 2], 3), "one": ([4], [4], 1), "ring": ([0, 0, 0, 1, 1, 2, 2, 2], [0, 1, 2, 0, 2, 0, 1, 2], 9)}
    for rows, cols, area in shapes.values():
        assert cells.hull_area(np.array(rows), np.array(cols)) == area


@pytest.mark.parametrize("seed", range(20))
def test_hull_against_every_line(seed):
    """A centre is in the hull unless a line through two corners parts it from all of them."""
    g = np.random.default_rng(seed)
    mask = g.random((5, 6)) < 0.3
    mask[2, 3] = True
    r, c = np.nonzero(mask)
    corners = [(2 * a + x, 2 * b + y) for a, b in zip(r, c) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    side = lambda p, q, x: (q[0] - p[0]) * (x[1] - p[1]) - (q[1] - p[1]) * (x[0] - p[0])
    lines = [(p, q) for p in corners for q in corners if p != q and all(side(p, q, x) >= 0 for x in corners)]
    want = sum(all(side(p, q, (2 * a, 2 * b)) >= 0 for p, q in lines) for a in range(5) for b in range(6))
    assert cells.hull_area(r, c) == want


def test_tiff_round_trip_and_polygon():
    for kind, top in ((np.uint8, 200), (np.uint16, 300), (np.uint32, 70_000)):
        a = np.array([[0, top], [1, 2], [3, 4]], kind)
        assert (images.decode_tiff(images.encode_tiff(a)) == a).all()
    assert images.fill_polygon(np.array([[1, 1], [4, 1], [4, 3], [1, 3]], float), 6, 6).sum() == 6


def test_p_values():
    assert stats.spearman_p(0.5, 20) == pytest.approx(0.02475, abs=1e-4)
    assert stats.mann_whitney_p(50, 10, 10) == pytest.approx(1.0)


@pytest.mark.parametrize("n1,n2", [(1, 3), (3, 4), (5, 2), (4, 4)])
def test_exact_rank_sum_against_all_choices(n1, n2):
    us = [sum(ranks) - n1 * (n1 + 1) / 2 for ranks in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in set(us):
        top = max(u, n1 * n2 - u)
        assert stats.mann_whitney_exact_p(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(x >= top for x in us) / len(us)))


def test_rank_sum_test_picks_its_method(spark):
    df = lambda a, b: spark.createDataFrame([(float(x), "a") for x in a] + [(float(x), "b") for x in b] + [(None, "a"), (1.0, None)], "v double, g string")
    few = stats.mann_whitney_test(df([1, 2, 3], [4, 5, 6, 7]), "v", "g")
    assert (few["u"], few["n1"], few["n2"], few["method"]) == (0.0, 3, 4, "exact") and few["p"] == pytest.approx(2 / 35)
    tied = stats.mann_whitney_test(df([1, 1, 2], [1, 2, 2, 3]), "v", "g")
    n, ties = 7, 3**3 - 3 + 3**3 - 3
    z = (abs(tied["u"] - 6) - 0.5) / math.sqrt(12 / 12 * (n + 1 - ties / (n * (n - 1))))
    assert tied["method"] == "asymptotic" and tied["p"] == pytest.approx(math.erfc(z / math.sqrt(2)))
    with pytest.raises(ValueError):
        stats.mann_whitney_test(df([1], []), "v", "g")


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(f"g{i % 12}", "ab"[i % 12 % 2], i) for i in range(240)], "g string, y string, i int")
    folds = stats.group_folds(df, "g", "y", 3)
    assert folds.count() == 12 and folds.select("fold").distinct().count() == 3


def test_alignment_is_a_permutation():
    a = np.array([[0.0, 0], [5, 5], [9, 0]])
    assert phenotypes.align(a[[2, 0, 1]], a) == [2, 0, 1]


def test_registered_queries_match_sql(spark):
    import duckdb

    from cellspark.plans import queries

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "lineitem orders events customer part embeddings nation supplier".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("overlap_iou", "match_metrics", "qc_flags", "crowding", "even_spaced_pick", "class_metrics", "shapes", "cell_table", "name_index", "two_stage_search"):
        df = queries.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
        r = con.execute(queries.ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(str(x[names.index(c)]) for c in cols) for x in r.fetchall()), name


def test_statistics_queries_do_the_whole_job():
    import inspect

    from cellspark.operators import bootstrap, classifier, validation

    default = lambda f, name: inspect.signature(f).parameters[name].default
    assert default(bootstrap.means, "draws") == 2000 and default(phenotypes.cluster, "restarts") == 20
    assert default(classifier.cross_validate, "folds") == 5 and set(default(classifier.cross_validate, "models")) == {"logistic_regression", "random_forest"}
    assert default(classifier.cross_validate, "trees") == 300 and default(validation.stability, "refits") == 100


def test_sparse_assignment_against_all_choices():
    import itertools

    r = np.random.default_rng(1)
    for _ in range(300):
        n, m = int(r.integers(1, 5)), int(r.integers(1, 5))
        w = np.where(r.random((n, m)) < 0.6, np.round(r.random((n, m)), 1), 0)
        got = matching.sparse_assignment([[(j, -w[i, j]) for j in range(m) if w[i, j] > 0] for i in range(n)])
        assert len({x for x in got if x is not None}) == sum(x is not None for x in got)
        best = max(sum(w[i, j] for i, j in enumerate(p) if j is not None) for p in itertools.permutations([*range(m), *[None] * n], n))
        assert sum(w[i, j] for i, j in enumerate(got) if j is not None) == pytest.approx(best)


def test_assignment_of_a_long_chain_and_many_parts(spark):
    """A chain of labels that overlap in turn, where the greedy choice is wrong, beside parts of one pair."""
    chain = [("x", i, i, 0.40) for i in range(300)] + [("x", i, i + 1, 0.401) for i in range(299)]
    lone = [("x", 1000 + i, 1000 + i, 0.9) for i in range(200)] + [("y", 0, 0, 0.3), (None, 1, 1, 0.5)]
    got = matching.assign(spark.createDataFrame(chain + lone, "image string, gt_label long, pred_label long, iou double").repartition(6)).collect()
    assert len([r for r in got if r.image == "x" and r.gt_label < 300]) == 300 and sum(r.iou for r in got if r.image == "x" and r.gt_label < 300) == pytest.approx(300 * 0.40)
    assert sorted((str(r.image), r.gt_label, r.matched) for r in got if r.gt_label >= 1000 or r.image != "x") == sorted([("x", 1000 + i, True) for i in range(200)] + [("y", 0, False), ("None", 1, True)])


def test_lonely_cells_find_their_nearest(spark):
    r = np.random.default_rng(3)
    rows = [("a", i, float(y), float(x)) for i, (y, x) in enumerate(r.uniform(0, 9000, (150, 2)))] + [("b", 1, 0.0, 0.0), ("b", 2, 3e6, 4e6), ("c", 1, 5.0, 5.0), ("d", 1, None, 1.0), ("d", 2, 1.0, 1.0), ("d", 3, 1.0, 31.0), ("e", 1, 0.0, 0.0), ("e", 2, 0.0, 50.0)]
    got = {(x.i, x.c): x for x in cells.crowding(spark.createDataFrame(rows, "i string, c int, y double, x double"), "i", "c", "y", "x").collect()}
    assert len(got) == len(rows)
    for i, c, y, x in rows:
        d = [np.hypot(y - q[2], x - q[3]) for q in rows if q[0] == i and q[1] != c and q[2] is not None] if y is not None else []
        assert got[i, c].neighbours_within_50px == sum(v <= 50 for v in d)
        assert got[i, c].nearest_neighbour_distance == (pytest.approx(min(d)) if d else None)


def test_regions_of_a_batch_against_single_ones():
    r = np.random.default_rng(0)
    region, row, col, want = [], [], [], []
    for k in range(60):
        m = r.random(r.integers(1, 9, 2)) < r.choice([0.3, 0.7, 1.0])
        m[0, 0] = True
        y, x = np.nonzero(m)
        off = r.integers(0, 500, 2)
        region, row, col = region + [7 * k] * len(y), row + (y + off[0]).tolist(), col + (x + off[1]).tolist()
        want.append((cells.perimeter(m), cells.perimeter_crofton(m), len(y) / cells.hull_area(y, x)))
    i = r.permutation(len(region))
    names, *got = cells.region_batch(np.array(region)[i], np.array(row)[i], np.array(col)[i])
    assert (names == 7 * np.arange(60)).all() and np.stack(got, 1) == pytest.approx(np.array(want))


def test_outlines_in_small_batches_are_the_same(spark, monkeypatch):
    rows = [("ab"[k % 2], k, i // 3, i % 3 + k) for k in range(1, 30) for i in range(1 + k % 9)]
    df = spark.createDataFrame(rows, "image string, label long, row int, col int")
    one = sorted(map(tuple, cells.outlines(df).collect()))
    monkeypatch.setattr(cells, "BATCH_PIXELS", 4)
    assert sorted(map(tuple, cells.outlines(df).collect())) == one and len(one) == 29


def test_folds_of_equal_groups_are_dealt_in_rounds():
    dealt = np.array(stats.deal_folds([((3, 0), 7), ((0, 3), 7)], 3))
    assert dealt.sum(1).tolist() == [7, 7] and set(dealt.ravel()) == {2, 3} and dealt.sum(0).max() == 5
    assert [sum(x) for x in stats.deal_folds([((1, 2), 5), ((9, 0), 1)], 4)] == [5, 1] and stats.deal_folds([], 2) == []


def plain_bootstrap(x, draws, chunk, seed):
    """Means of resamples of sorted x in NumPy: a tree of binomial splits, then draws within each chunk."""
    n, sums = len(x), np.zeros(draws)

    def split(low, high, counts):
        if high - low == 1:
            rng, own = np.random.default_rng([*seed, low]), x[low * chunk : high * chunk]
            picks = own[rng.integers(0, len(own), counts.sum())]
            for d, part in enumerate(np.split(picks, np.cumsum(counts)[:-1])):
                sums[d] += part.sum()
            return
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(counts, (mid - low) * chunk / (min(n, high * chunk) - low * chunk))
        split(low, mid, left)
        split(mid, high, counts - left)

    split(0, -(-n // chunk), np.full(draws, n))
    return sums / n


@pytest.mark.parametrize("chunk", [4096, 16])
def test_bootstrap_against_numpy(spark, chunk):
    from cellspark.operators import bootstrap

    g = np.random.default_rng(6)
    groups = {"a": np.round(g.normal(5, 2, 150), 1), "b": np.repeat(3.0, 40), "c": g.exponential(1, 77)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("d", None), ("d", float("nan")), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in bootstrap.means(df, ["g"], "v", 300, 11, chunk).collect()}
    assert set(got) == set("abcd") and got["d"].n_images == 0 and got["d"].mean is None and got["d"].ci_lower is None
    for k, x in groups.items():
        want = plain_bootstrap(np.sort(x), 300, chunk, bootstrap.own_seed(11, k))
        assert got[k].n_images == len(x) and got[k].mean == pytest.approx(x.mean())
        assert [got[k].ci_lower, got[k].ci_upper] == pytest.approx(list(np.percentile(want, [2.5, 97.5])), abs=1e-9)
        assert want.std() == pytest.approx(x.std() / np.sqrt(len(x)), rel=0.15, abs=1e-12)


def test_change_over_time_against_numpy(spark):
    from cellspark.operators import bootstrap, validation

    g = np.random.default_rng(2)
    rows = [(c, t, float(v)) for c in (1, 2) for t in (0.0, 4.0, 8.0) for v in g.normal(c + t, 1, 30)] + [(3, 0.0, 1.0), (3, 4.0, 2.0)]
    got = {r.c: r for r in validation.change_over_time(spark.createDataFrame(rows, "c int, t double, v double"), "t", "c", "v", 200, 5).collect()}
    for c in (1, 2):
        early, late = (np.sort([v for x, t, v in rows if x == c and t == at]) for at in (0.0, 8.0))
        change = plain_bootstrap(late, 200, bootstrap.CHUNK, bootstrap.own_seed(5, c, 1)) - plain_bootstrap(early, 200, bootstrap.CHUNK, bootstrap.own_seed(5, c, 0))
        assert [got[c].bootstrap_ci_lower, got[c].bootstrap_ci_upper] == pytest.approx(list(np.percentile(change, [2.5, 97.5])))
        assert got[c].change_latest_minus_earliest == pytest.approx(late.mean() - early.mean()) and got[c].n_images_latest == 30
    assert got[3].change_latest_minus_earliest is None and got[3].bootstrap_ci_lower is None and got[3].n_images_latest == 0


def test_kmeans_passes_against_single_fits(spark):
    from cellspark.operators import kmeans

    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(m, 0.6, (60, 2)) for m in ((0, 0), (4, 4), (0, 5))])
    w = g.integers(0, 3, (len(x), 3)).astype(float)
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, w)], "x array<double>, w array<double>").repartition(4)
    centres, cost = kmeans.fit(rows, 3, 5, 9, refits=3)
    for r in range(3):
        single, one = kmeans.fit(rows.withColumn("w", F.array(F.col("w")[r])), 3, 5, 9)
        order = lambda c: c[np.lexsort(c.T)]
        assert order(centres[r]) == pytest.approx(order(single[0]), abs=1e-6) and cost[r] == pytest.approx(one[0])
        own, dist = kmeans.nearest(x, centres[r])
        assert cost[r] == pytest.approx((dist * w[:, r]).sum())
        for j in range(3):  # each centre is the weighted mean of its rows
            mine = own == j
            assert centres[r, j] == pytest.approx((x[mine] * w[mine, r, None]).sum(0) / w[mine, r].sum(), abs=1e-3)
    found = kmeans.contingency(rows.withColumn("y", (F.col("x")[0] > 2).cast("int")), "y", centres)
    assert found.groupBy("refit").agg(F.sum("n").alias("n")).collect() == [(r, 180) for r in range(3)] or {r.n for r in found.groupBy("refit").agg(F.sum("n").alias("n")).collect()} == {180}


def test_refit_weights_are_those_of_single_draws(spark):
    from cellspark.operators import validation

    df = spark.range(50).withColumnRenamed("id", "k")
    both = {r.k: r.w for r in validation.refit_weights(df, ["k"], 3, 7).collect()}
    for i in range(3):
        single = {r.k: r.weight for r in validation.bootstrap_weights(df, ["k"], 8 + i).collect()}
        assert {k: w[i] for k, w in both.items() if w[i]} == single and sum(single.values()) == 50


def test_exact_quantiles_against_numpy(spark):
    g = np.random.default_rng(3)
    rows = [("ab"[i % 2], float(x)) for i, x in enumerate(np.concatenate([g.normal(size=400), np.repeat(0.5, 100), [1e9, -1e9]]))] + [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    from cellspark.operators.quantiles import column_quantiles, counted, quantiles, value_ranks

    shares = [0.0, 0.01, 0.25, 0.5, 0.777, 1.0]
    got = {r.k: r.q for r in quantiles(df, "v", shares, "k").collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert got[k] == pytest.approx(list(np.quantile([v for x, v in rows if x == k], shares)))
    every = [v for _, v in rows if v is not None]
    assert quantiles(df, "v", shares).first().q == pytest.approx(list(np.quantile(every, shares)))
    assert column_quantiles(df.withColumn("w", -F.col("v")), ["v", "w"], [0.25]).first().w[0] == pytest.approx(np.quantile([-v for v in every], 0.25))
    ranks = {r.v: r["rank"] for r in value_ranks(df, "v").collect()}
    assert all(ranks[v] == sum(x < v for x in every) + (sum(x == v for x in every) + 1) / 2 for v in every)
    assert counted(df.where("false"), "v").count() == 0 and quantiles(df.where("false"), "v", [0.5]).first().q == [None]


def test_quantiles_narrow_their_brackets(spark):
    from cellspark.operators.quantiles import counted, medians, quantiles

    g = np.random.default_rng(8)
    rows = [("ab"[i % 2], float(x)) for i, x in enumerate(np.concatenate([g.lognormal(0, 30, 3000), np.repeat(0.5, 2500), [1e300, -1e300]]))] + [("c", 7.0), ("d", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = [0.0, 0.003, 0.5, 0.9, 1.0]
    for most in (5, 300):  # what strictly lies inside must get as few; the many equal values can't
        got = {r.k: r.q for r in quantiles(df, "v", shares, "k", most=most).collect()}
        assert set(got) == {"a", "b", "c", None}  # a NULL key is a key
        for k in got:
            assert got[k] == pytest.approx(list(np.quantile([v for x, v in rows if x == k and v is not None], shares)), rel=1e-12)
    assert {r.k: r.v for r in medians(df, ["v"], "k").collect()} == {k: pytest.approx(float(np.median([v for x, v in rows if x == k and v is not None]))) for k in got}
    below = {(r.k, r.v): (r.n, r.below, r.total) for r in counted(df, "v", "k").collect()}
    for (k, v), found in below.items():
        own = [x for y, x in rows if y == k and x is not None]
        assert found == (own.count(v), sum(x < v for x in own), len(own))
    assert len(below) == len({x for x in rows if x[1] is not None})


def test_groups_draw_independently(spark):
    from cellspark.operators import bootstrap

    df = spark.createDataFrame([(g, float(i)) for g in "abc" for i in range(50)], "g string, v double")
    run = lambda d: {r.g: (r.mean, r.ci_lower, r.ci_upper) for r in bootstrap.means(d, ["g"], "v", 200).collect()}
    got = run(df)
    assert len({x[1:] for x in got.values()}) == 3 and {x[0] for x in got.values()} == {24.5} and got == run(df.repartition(3))


def test_evaluation_statuses_in_order(spark):
    df = spark.createDataFrame([("a", i, i % 2 == 0) for i in range(6)] + [("b", 1, True)], "line string, i int, found boolean")
    run = lambda **more: [(r.line, r.i, r.status) for r in stats.capped_status(df, "line", "i", F.col("found"), 2, F.col("line") == "a", **more).orderBy("line", "i").collect()]
    assert [x[2] for x in run()] == ["evaluated", "not_in_annotation_file", "evaluated", "evaluation_limit_reached", "evaluation_limit_reached", "evaluation_limit_reached", "annotation_file_not_found"]
    assert {x[2] for x in run(enabled=False)} == {"evaluation_disabled"}


def test_kmeans_starts_from_all_values_however_often_each_stands(spark, monkeypatch):
    from cellspark.operators import kmeans, phenotypes

    monkeypatch.setattr(kmeans, "FIRST_ROWS", 6)  # fewer than any value has copies
    rows = [(100.0 * (i % 3), 7.0 * (i % 3 == 1)) for i in range(60)]
    got = phenotypes.cluster(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], 3, order_by="a").distinct().collect()
    assert sorted((r.a, r.phenotype_cluster) for r in got) == [(0.0, 1), (100.0, 2), (200.0, 3)]


def test_draws_are_dealt_among_chunks(spark, monkeypatch):
    from cellspark.operators import validation

    monkeypatch.setattr(validation, "CHUNK", 100)
    df = spark.range(2000).select(F.col("id").alias("k"))
    w = np.array([r.w for r in validation.refit_weights(df, ["k"], 20, 7).orderBy("k").collect()])
    again = np.array([r.w for r in validation.refit_weights(df.repartition(3), ["k"], 20, 7).orderBy("k").collect()])
    assert w.shape == (2000, 20) and (w.sum(0) == 2000).all() and (w == again).all()
    assert 0.61 < (w > 0).mean() < 0.655 and abs(w.var() - 1) < 0.05 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.1


def test_hulls_of_many_regions_are_those_of_each():
    g = np.random.default_rng(8)
    region, row, col, want = [], [], [], []
    for k in range(200):
        side = 150 if k % 50 == 0 else 9
        m = g.random((int(g.integers(1, side)), int(g.integers(1, side)))) < (0.01 if side == 150 else g.random())
        m[-1, 0] = True
        y, x = np.nonzero(m)
        region, row, col = region + [k] * len(y), row + y.tolist(), col + x.tolist()
        want.append(cells.hull_area(y, x))
    assert (cells.hull_areas(np.array(region), np.array(row), np.array(col)) == want).all()


def test_pairs_that_outweigh_their_rivals_need_no_parts(spark, monkeypatch):
    chain = [(None if i > 20 else "x", i, i + j, 0.6 - 0.4 * j) for i in range(40) for j in (0, 1)]
    df = spark.createDataFrame(chain, "image string, gt_label int, pred_label int, iou double")
    with monkeypatch.context() as m:
        m.setattr(matching, "components", lambda links: pytest.fail("parts are looked for"))
        got = matching.assign(df)
        assert sorted((r.gt_label, r.pred_label, r.matched) for r in got.collect()) == [(i, i, True) for i in range(40)] and dict(got.dtypes)["gt_label"] == "bigint"
        assert not matching.assign(df.where("false")).collect()


def test_settled_pairs_leave_the_best_assignment(spark):
    g = np.random.default_rng(6)
    w = np.where(g.random((3, 8, 9)) < 0.35, g.integers(1, 900, (3, 8, 9)) / 1000, 0)
    w[0, range(8), range(8)] = 0.95
    df = spark.createDataFrame([(f"i{k}", a + 1, b + 1, float(w[k, a, b])) for k, a, b in np.argwhere(w).tolist()], "image string, gt_label int, pred_label int, iou double")
    got = matching.assign(df).toPandas()
    for k in range(3):
        best = matching.sparse_assignment([[(b, -w[k, a, b]) for b in range(9) if w[k, a, b]] for a in range(8)])
        mine = got[got.image == f"i{k}"]
        assert mine.gt_label.is_unique and mine.pred_label.is_unique and mine.iou.sum() == pytest.approx(sum(w[k, a, b] for a, b in enumerate(best) if b is not None))


def test_cells_ask_few_squares(spark, monkeypatch):
    g = np.random.default_rng(3)
    at = np.round(g.uniform(-400, 400, (300, 2)), 1)
    df = spark.createDataFrame([("a", i, *map(float, p)) for i, p in enumerate(at)], "i string, c int, y double, x double")
    rows = {}
    plain = cells.written
    monkeypatch.setattr(cells, "written", lambda d: rows.setdefault(len(rows), plain(d)))
    got = {r.c: (r.neighbours_within_50px, r.nearest_neighbour_distance) for r in cells.crowding(df, "i", "c", "y", "x").collect()}
    assert rows[0].count() == sum(1 for n, _ in got.values() if n)  # neighbours are counted once, and kept
    for i, p in enumerate(at):
        d = np.delete(np.sqrt(((at - p) ** 2).sum(1)), i)
        assert got[i] == (int((d <= 50).sum()), pytest.approx(d.min()))


def test_limits_of_lines_are_broadcast_to_the_cells(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("line"), F.col("id").cast("double").alias("v"))
    out = cells.qc_flags(df, cells.area_limits(df, "v", 0.1, 0.9, "line"), "v", ["v"], F.lit(False), "line")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and out.where("qc_extreme_area").count() == 60


def test_limits_of_lines_are_broadcast_by_their_true_size(spark):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3).alias("line"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")  # many cells: what is estimated from them is more
    try:
        out = cells.qc_flags(df, cells.area_limits(df, "v", 0.1, 0.9, "line"), "v", ["v"], F.lit(False), "line")
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
