"""Rank statistics, scaling, agreement, selection and class metrics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from .quantiles import column_quantiles, counted, medians, quantiles, value_ranks
from .tables import join_on, written


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(rho, n): correlation of average ranks over rows with both values.

    Ranks meet pairs of values, counted before, so that a frequent value is no hot key; they
    are centred on their mean, which is known.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("__a"), F.col(b).alias("__b")).agg(F.count("*").alias("__k"))
    side = lambda c, name: value_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(c).alias(name)), name).select(name, F.col("rank").alias(f"{name}_rank"))
    total = pairs.agg(F.sum("__k").alias("__n"))
    both = pairs.join(side(a, "__a"), "__a").join(side(b, "__b"), "__b").crossJoin(F.broadcast(total))  # one row
    x, y = F.col("__a_rank") - (F.col("__n") + 1) / 2, F.col("__b_rank") - (F.col("__n") + 1) / 2
    sums = both.agg(*(F.sum(F.col("__k") * v).alias(c) for c, v in (("__xy", x * y), ("__xx", x * x), ("__yy", y * y))), F.coalesce(F.sum("__k"), F.lit(0)).alias("n"))
    return sums.select(F.try_divide("__xy", F.sqrt(F.col("__xx") * F.col("__yy"))).alias("rho"), "n")


def beta_tail(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + t * d) or 1e-300)
            c = (1 + t / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p-value by the t approximation."""
    if n < 3 or rho is None or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1:
        return 0.0
    t2 = rho * rho * (n - 2) / (1 - rho * rho)
    return beta_tail((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, u, ties) of both groups: rank sums over all rows, ties averaged; ties = sum of t^3 - t over values."""
    r = value_ranks(df.where(F.col(group).isNotNull()), value)
    ties = r.agg(F.coalesce(F.sum(F.pow(F.col("n"), 3) - F.col("n")), F.lit(0.0)).alias("ties"))
    s = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k")).join(r.select(value, "rank"), value)
    return s.groupBy(group).agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("rank")) - F.sum("k") * (F.sum("k") + 1) / 2).alias("u")).crossJoin(F.broadcast(ties))  # one row


def mann_whitney_exact_p(u: float, n1: int, n2: int) -> float:
    """Two-sided p-value of the exact distribution of U without ties: counts of rank sets by their sum."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    for j in range(1, n1 + n2 + 1):  # each rank in turn may join the first group
        for i in range(min(j, n1), 0, -1):
            shift = j - i
            ways[i, shift:] += ways[i - 1, : ways.shape[1] - shift] if shift else ways[i - 1]
    top = max(u, n1 * n2 - u)
    return float(min(1.0, 2 * ways[n1, math.ceil(top) :].sum() / ways[n1].sum()))


def mann_whitney_test(df: DataFrame, value: str, group: str) -> dict:
    """U of the first group in order, both sizes and the two-sided p-value.

    Exact where a group has at most 8 rows and no values tie, else by the normal approximation.
    """
    rows = sorted(mann_whitney(df, value, group).collect(), key=lambda r: r[0])  # two groups
    if len(rows) != 2:
        raise ValueError(f"two groups are compared, not {len(rows)}")
    a, b = rows
    exact = min(a["n"], b["n"]) <= 8 and not a["ties"]
    p = mann_whitney_exact_p(a["u"], a["n"], b["n"]) if exact else mann_whitney_p(a["u"], a["n"], b["n"], a["ties"])
    return {"group": a[0], "u": a["u"], "n1": a["n"], "n2": b["n"], "p": p, "method": "exact" if exact else "asymptotic"}


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Two-sided normal approximation with continuity and tie corrections; ties = sum of t^3 - t."""
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0
    if var <= 0:
        return 1.0
    z = max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return math.erfc(z / math.sqrt(2))


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_quantiles(df, columns, [0.25, 0.5, 0.75]).withColumnsRenamed({c: f"__{c}" for c in columns})


def robust_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - median) / IQR of each column, exact; a zero IQR divides by 1."""
    out = df.crossJoin(F.broadcast(_quartiles(df, columns)))  # one row
    q = lambda c, i: F.get(F.col(f"__{c}"), i)
    scale = lambda c: F.when(q(c, 2) == q(c, 0), 1.0).otherwise(q(c, 2) - q(c, 0))
    return out.withColumns({f"{c}_scaled": (F.col(c) - q(c, 1)) / scale(c) for c in columns}).drop(*(f"__{c}" for c in columns))


def scaling(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """The same as expressions with the quartiles of ``df`` as constants, which come to the driver: for rows that aren't in ``df``, too."""
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75]).first()
    none = [None] * 3
    return {f"{c}_scaled": (F.col(c) - F.lit((q[c] or none)[1])) / F.lit(((q[c] or none)[2] or 0) - ((q[c] or none)[0] or 0) or 1.0) for c in columns}


def relative_profile(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(median of the group - global median) / global IQR; NULL where the IQR is 0."""
    m = medians(df, columns, key).crossJoin(F.broadcast(_quartiles(df, columns)))  # one row
    q = lambda c, i: F.get(F.col(f"__{c}"), i)
    return m.select(key, *(F.try_divide(F.col(c) - q(c, 1), q(c, 2) - q(c, 0)).alias(c) for c in columns))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) from the contingency table of two labellings."""
    n = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: c * (c - 1) / 2
    sa = n.groupBy(a).agg(F.sum("n").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("pa"))
    sb = n.groupBy(b).agg(F.sum("n").alias("s")).agg(F.sum(pairs(F.col("s"))).alias("pb"))
    t = n.agg(F.sum(pairs(F.col("n"))).alias("pn"), F.sum("n").alias("t")).crossJoin(sa).crossJoin(sb)  # one row each
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs(F.col("t")))
    top = (F.col("pa") + F.col("pb")) / 2
    return t.select(F.coalesce(F.try_divide(F.col("pn") - expected, top - expected), F.lit(1.0)).alias("ari"))


def adjusted_rand_of(table: np.ndarray) -> float:
    """The same of a contingency table."""
    pairs = lambda c: float((c * (c - 1) / 2).sum())
    both, a, b, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), pairs(table.sum())
    expected, top = (a * b / n if n else 0.0), (a + b) / 2
    return (both - expected) / (top - expected) if top != expected else 1.0


def confusion(df: DataFrame, true: str, pred: str, labels: list) -> DataFrame:
    """Counts, a row for each true label and a column for each predicted one."""
    return df.groupBy(true).pivot(pred, labels).count().na.fill(0)


def normalised_confusion(counts: DataFrame, true: str, labels: list) -> DataFrame:
    """Each row of ``confusion`` as shares of its sum, 0 where a class has no rows."""
    total = sum((F.col(str(x)) for x in labels), F.lit(0))
    return counts.select(true, *(E.ratio(F.col(str(x)), total).alias(str(x)) for x in labels))


def label_counts(df: DataFrame, true: str, pred: str) -> DataFrame:
    """(true, pred, n): how often each pair of labels occurs."""
    return df.groupBy(true, pred).agg(F.count("*").alias("n"))


def class_metrics(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    return metrics_of_counts(label_counts(df, true, pred), true, pred)


def metrics_of_counts(n: DataFrame, true: str, pred: str) -> DataFrame:
    """``class_metrics`` of rows that ``label_counts`` has counted."""
    rows = n.select(F.col(true).alias("label"), F.col("n").alias("support"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("predicted"))
    cols = n.select(F.col(pred).alias("label"), F.lit(0).alias("support"), F.lit(0).alias("tp"), F.col("n").alias("predicted"))
    s = rows.unionByName(cols).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "tp", "predicted")))
    p, r, f = E.scores(F.col("tp"), F.col("predicted") - F.col("tp"), F.col("support") - F.col("tp"))
    return s.select("label", p.alias("precision"), r.alias("recall"), f.alias("f1"), "support")


def overall_metrics(per_class: DataFrame, labelled: DataFrame, true: str, pred: str, weight: Column | None = None) -> DataFrame:
    """One row; with ``weight`` (whole numbers) rows of ``labelled`` count as often as it says."""
    right, each = (F.col(true) == F.col(pred)).cast("double"), F.lit(1) if weight is None else weight
    a = labelled.agg((F.sum(right * each) / F.sum(F.when(right.isNotNull(), each))).alias("accuracy"))
    return per_class.where("support > 0").agg(F.avg("recall").alias("balanced_accuracy")).crossJoin(per_class.agg(F.avg("f1").alias("macro_f1"))).crossJoin(a)  # one row each


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def even_pick(df: DataFrame, key: str, order: str, m: int) -> DataFrame:
    """About m evenly spaced rows of each key in order of ``order``; all where there are no more."""
    sizes = {r[0]: r[1] for r in df.groupBy(key).count().collect()}  # a row for each line of cells
    spots = [(k, int(i) + 1) for k, n in sizes.items() for i in sorted(set(np.linspace(0, n - 1, m, dtype=int).tolist() if n > m else range(n)))]
    kind = dict(df.dtypes)[key]
    wanted = df.sparkSession.createDataFrame(spots, f"`{key}` {kind}, selection_rank int")
    ranks = counted(df, order, key).select(key, order, "below")  # by ranges: a line may hold most of all rows
    within = F.row_number().over(Window.partitionBy(key, order).orderBy(order))
    ranked = join_on(df, ranks, [key, order]).withColumn("selection_rank", (F.col("below") + within).cast("int")).drop("below")
    return ranked.join(wanted, [key, "selection_rank"], "left_semi")


def diverse_top(df: DataFrame, key: str, spread: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each key: first the best of each ``spread``, then the next best."""
    first = F.row_number().over(Window.partitionBy(key, spread).orderBy(*order))
    out = df.withColumn("pass", F.when(first == 1, 1).otherwise(2))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pass", *order))
    return out.withColumn("selection_rank", rank).where(F.col("selection_rank") <= n).drop("pass")


def capped_status(df: DataFrame, key: str, order: str, found: Column, cap: int, annotated: Column | None = None, enabled: bool = True) -> DataFrame:
    """What becomes of each image's evaluation, in this order: evaluation_disabled, annotation_file_not_found,
    evaluation_limit_reached, not_in_annotation_file, evaluated.

    ``annotated`` tells whether the line has an annotation file, ``found`` whether the file
    names the image.  The cap counts what was evaluated before, in order.
    """
    if not enabled:
        return df.withColumn("status", F.lit("evaluation_disabled"))
    has = F.lit(True) if annotated is None else F.coalesce(annotated, F.lit(False))
    scored = (has & F.coalesce(found, F.lit(False))).cast("int")
    # counts of earlier values of the order by ranges, then those of the same value
    earlier = counted(df, order, key, weight=scored).select(key, order, F.col("below").alias("__below"))
    same = F.coalesce(F.sum(scored).over(Window.partitionBy(key, order).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce("__below", F.lit(0)) + same
    return join_on(df, earlier, [key, order], "left").withColumn("status", F.when(~has, "annotation_file_not_found").when(before >= cap, "evaluation_limit_reached").when(scored == 1, "evaluated").otherwise("not_in_annotation_file")).drop("__below")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, median, q75, max) of each numeric column, exact; std is the sample's."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns)))
    long = df.select(pairs.alias("x")).select("x.*")
    plain = long.groupBy("column").agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(long, "v", [0.25, 0.5, 0.75], "column").select("column", *(F.get("q", i).alias(n) for i, n in enumerate(("q25", "median", "q75"))))
    return plain.join(q, "column", "left").select("column", "count", "mean", "std", "min", "q25", "median", "q75", "max")


def by_strength(correlations: DataFrame) -> DataFrame:
    """Strongest correlation first, whatever its sign; undefined ones last."""
    return correlations.orderBy(F.desc_nulls_last(F.abs("rho")))


def sampled(df: DataFrame, most: int, seed: int, *ids: str) -> DataFrame:
    """At most so many rows for a plot, chosen by a seeded hash of the ids: the same on every run."""
    return df.orderBy(F.xxhash64(*ids, F.lit(seed)), *ids).limit(most)


def balanced_sample(df: DataFrame, key: str, most: int, seed: int, *ids: str, classes: list | None = None) -> DataFrame:
    """As many rows of every class: the smallest class' count, ``most`` at most; chosen by a seeded hash.

    With ``classes``, one of them that has no row is an error.  Of a large class only the lowest hashes are ranked, about
    as many as are taken; where fewer than these turn out to be so low, the whole class is.
    """
    counts = {r[0]: r[1] for r in df.groupBy(key).count().collect()}  # a row for each class
    if missing := [c for c in classes or () if not counts.get(c)]:
        raise ValueError(f"no rows of class {missing}")
    h, wanted = F.xxhash64(*ids, F.lit(seed)), min([most, *counts.values()])
    share = {k: (wanted + 10 * math.sqrt(wanted) + 100) / n for k, n in counts.items() if k is not None}
    low = low_hashes(h, key, share)
    if low is not None:
        enough = {r[0] for r in df.where(low).groupBy(key).count().collect() if r[1] >= wanted}
        low = low_hashes(h, key, {k: x for k, x in share.items() if k in enough})
    rank = F.row_number().over(Window.partitionBy(key).orderBy(h, *ids))
    return (df if low is None else df.where(low)).withColumn("__rank", rank).where(F.col("__rank") <= wanted).drop("__rank")


def low_hashes(h: Column, key: str, share: dict) -> Column | None:
    """Whether the hash is in the lowest ``share`` of a class; all rows of other classes.  None where all rows are."""
    ends = [F.lit(x) for k, s in share.items() if s < 1 for x in (k, int(s * 2**64) - 2**63)]
    return h <= F.coalesce(F.element_at(F.create_map(*ends), F.col(key)), F.lit(2**63 - 1)) if ends else None


def deal_folds(types: list[tuple[tuple[int, ...], int]], folds: int) -> list[list[int]]:
    """For each (counts of a group by class, groups that have them) how many of these groups each fold gets.

    The most uneven come first.  Whole rounds are dealt to all folds alike, each of the rest to the fold where the
    classes then differ least, of equals to the one with the fewest rows, then to the first.
    """
    counts = np.array([c for c, _ in types], float).reshape(len(types), len(types[0][0]) if types else 0)
    total = np.maximum((counts * np.array([[n] for _, n in types])).sum(0), 1)
    held, out = np.zeros((folds, counts.shape[1])), [[0] * folds for _ in types]
    for i in sorted(range(len(types)), key=lambda i: (-counts[i].std(), types[i][0])):
        rounds, rest = divmod(types[i][1], folds)
        held += rounds * counts[i]
        out[i] = [rounds] * folds
        for _ in range(rest):
            spread = [np.std((held + counts[i] * (np.arange(folds) == k)[:, None]) / total, axis=0).mean() for k in range(folds)]
            k = min(range(folds), key=lambda k: (round(spread[k], 12), held[k].sum(), k))
            held[k] += counts[i]
            out[i][k] += 1
    return out


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """(group, fold): groups are never split and classes spread evenly.

    Folds are dealt over the distinct counts of groups by class, and which groups of the same counts go where
    follows a seeded hash: no group comes to the driver.
    """
    labels = sorted(r[0] for r in df.select(label).distinct().collect() if r[0] is not None)  # a handful of classes
    vector = F.array(*(F.count_if(F.col(label) == y) for y in labels))
    groups = written(df.where(F.col(group).isNotNull()).groupBy(group).agg(vector.alias("__counts")).withColumn("__h", F.struct(F.xxhash64(group, F.lit(seed)), F.col(group).alias("g"))))
    types = [(tuple(r[0]), r[1]) for r in groups.groupBy("__counts").count().collect()]
    shares = deal_folds(types, folds)
    ends = [[int(x) for x in np.cumsum(s)] for s in shares]
    table = df.sparkSession.createDataFrame([(list(c), e) for (c, _), e in zip(types, ends, strict=True)], "__counts array<bigint>, __ends array<bigint>")
    placed = counted(groups, "__h", "__counts").select("__counts", F.col("__h.g").alias(group), F.col("below").alias("__place"))
    return placed.join(table, "__counts").select(group, F.size(F.filter("__ends", lambda e: e <= F.col("__place"))).cast("int").alias("fold"))


def leaks(train: DataFrame, test: DataFrame, group: str) -> DataFrame:
    """Groups that stand on both sides; must be empty."""
    return train.select(group).intersect(test.select(group))
