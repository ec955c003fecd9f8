"""Validation of clusters: bootstrap stability, change over time, prototypes and their nearest cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bootstrap, kmeans, phenotypes, stats
from .quantiles import medians, quantiles
from .tables import join_on

#: Seed, refits, restarts of each, resamples of means, cells shown of a cluster.
SEED, REFITS, RESTARTS, DRAWS, EXEMPLARS = 42, 100, 20, 2000, 6


def centres(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns))


def prototypes(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """The exact median of each column in each cluster, however many cells it has."""
    return medians(df, columns, label)


def prototype_distance(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """``df`` with the Euclidean distance of each row to its cluster's prototype."""
    at = prototypes(df, label, columns).withColumnsRenamed({c: f"__{c}" for c in columns})
    squares = sum((F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in columns), F.lit(0.0))
    return df.join(F.broadcast(at), label).withColumn("prototype_distance", F.sqrt(squares)).drop(*(f"__{c}" for c in columns))


def representatives(cells: DataFrame, label: str, columns: list[str], images: DataFrame, masks: DataFrame, image: str = "image", order: list[Column] | None = None, n: int = EXEMPLARS) -> DataFrame:
    """The cells nearest to each cluster's prototype, of different images where possible.

    Only images that have a file in ``images`` and in ``masks`` (both with the column ``image``) are shown;
    prototypes come from all cells.
    """
    near = prototype_distance(cells, label, columns).join(images.select(image), image, "left_semi").join(masks.select(image), image, "left_semi")
    return stats.diverse_top(near, label, image, [F.asc("prototype_distance"), *(order or [])], n)


def bootstrap_weights(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``df`` with weight, how often each row is drawn when as many as there are are drawn with replacement; rows not drawn go.

    ``keys`` name a row.
    """
    return _drawn(df, keys, [seed]).withColumn("weight", F.get("w", F.lit(0))).drop("w").where("weight > 0")


#: Rows that one task draws from at a time, about.
CHUNK = 50_000


def _drawn(df: DataFrame, keys: list[str], seeds: list[int]) -> DataFrame:
    """``df`` with w, how often each row is drawn for each of the seeds.

    Rows fall into chunks by a hash of their keys.  The n draws of a seed are dealt among the chunks by their sizes
    (the driver gets a row a chunk), and each chunk's among its rows in order of the hash: no draw is shuffled.
    """
    hashed = df.withColumn("__h", F.xxhash64(*keys))
    n = df.count()
    chunked = hashed.withColumn("__chunk", F.pmod(F.xxhash64("__h"), F.lit(max(1, -(-n // CHUNK)))))
    sizes = sorted((r[0], r[1]) for r in chunked.groupBy("__chunk").count().collect())
    shares = np.array([k for _, k in sizes], float) / max(n, 1)
    dealt = [np.random.default_rng([s, 0]).multinomial(n, shares) for s in seeds] if sizes else []
    held = {chunk: [int(d[i]) for d in dealt] for i, (chunk, _) in enumerate(sizes)}

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__h", *keys])
        chunk = int(rows["__chunk"].iloc[0])
        w = [np.bincount(np.random.default_rng([s, 1, chunk]).integers(0, len(rows), k), minlength=len(rows)) for s, k in zip(seeds, held[chunk], strict=True)]
        return rows.drop(columns=["__h", "__chunk"]).assign(w=list(np.array(w, float).T))

    return chunked.groupBy("__chunk").applyInPandas(draw, T.StructType([*df.schema, T.StructField("w", T.ArrayType(T.DoubleType()))]))


def agreement(df: DataFrame, reference: str, aligned: str) -> DataFrame:
    """(reference, agreement): the part of each reference cluster that keeps its label."""
    return df.groupBy(reference).agg(F.avg((F.col(reference) == F.col(aligned)).cast("double")).alias("agreement"))


def align_labels(df: DataFrame, raw: str, found: np.ndarray, reference: np.ndarray, numbers: list[int]) -> tuple[DataFrame, float]:
    """(``df`` with aligned_label, mean shift of the centres): raw label i goes to the number of the reference centre it is matched with."""
    to = phenotypes.align(found, reference)
    names = F.create_map(*(F.lit(x) for i, j in enumerate(to) for x in (i, numbers[j])))
    return df.withColumn("aligned_label", F.element_at(names, F.col(raw))), float(np.mean([np.linalg.norm(found[i] - reference[j]) for i, j in enumerate(to)]))


def refit_weights(df: DataFrame, keys: list[str], refits: int, seed: int) -> DataFrame:
    """``df`` with w, an array of how often each row is drawn in each refit; the draws of a refit are those of ``bootstrap_weights`` with its seed."""
    return _drawn(df, keys, [seed + 1 + r for r in range(refits)])


def stability(df: DataFrame, columns: list[str], label: str, keys: list[str], refits: int = REFITS, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """A row for each refit of K-means on a bootstrap sample: adjusted_rand_index, mean_centroid_shift, cluster_k_agreement.

    Every refit labels all rows.  ``columns`` are scaled already.  All starts of all refits take each step in one
    pass over the rows, and one more counts labels against the clusters of all refits.
    """
    numbers = sorted(r[0] for r in df.select(label).distinct().collect())  # a handful of clusters
    x = F.array(*(F.col(c).cast("double") for c in columns)).alias("x")
    rows = refit_weights(df.select(*dict.fromkeys([*keys, *columns])), keys, refits, seed).select(x, "w")
    own = {r[0]: r[1:] for r in centres(df, label, columns).collect()}
    reference = np.array([own[k] for k in numbers], float)
    found, _ = kmeans.fit(rows, len(numbers), restarts, seed, refits=refits)
    counts: dict = {}
    seen = df.groupBy(x, F.col(label).alias("__label")).agg(F.count("*").alias("n"))
    for r in kmeans.contingency(seen, "__label", found, "n").collect():  # refits times clusters squared
        counts[r["refit"], r["label"], r["prediction"]] = r["n"]
    out = []
    for i in range(refits):
        table = np.array([[counts.get((i, k, j), 0) for j in range(len(numbers))] for k in numbers], float)
        to = phenotypes.align(found[i], reference)
        shift = float(np.mean([np.linalg.norm(found[i][a] - reference[b]) for a, b in enumerate(to)]))
        kept = [float(table[b, to.index(b)] / max(1.0, table[b].sum())) for b in range(len(numbers))]
        out.append((i + 1, stats.adjusted_rand_of(table), shift, *kept))
    return df.sparkSession.createDataFrame(out, "bootstrap_iteration int, adjusted_rand_index double, mean_centroid_shift double" + "".join(f", cluster_{k}_agreement double" for k in numbers))


def stability_summary(table: DataFrame, index: str = "bootstrap_iteration") -> DataFrame:
    """(metric, mean, median, ci_lower, ci_upper) of every other column."""
    long = table.unpivot(index, [c for c in table.columns if c != index], "metric", "value")
    q = quantiles(long, "value", [0.5, 0.025, 0.975], "metric")
    return long.groupBy("metric").agg(F.avg("value").alias("mean")).join(q, "metric").select("metric", "mean", *(F.get("q", i).alias(n) for i, n in enumerate(("median", "ci_lower", "ci_upper"))))


def time_ends(df: DataFrame, time: str) -> tuple:
    """The earliest and the latest time; two different ones are needed."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None or low == high:
        raise ValueError("at least two times are needed")
    return low, high


def change_over_time(df: DataFrame, time: str, cluster: str, value: str, draws: int = DRAWS, seed: int = SEED + 2) -> DataFrame:
    """A row for each cluster: mean at the earliest and latest time, the change, and a bootstrap interval of it.

    Both ends are resampled independently, and clusters draw independently.  A cluster
    without values at one end has neither change nor interval.
    """
    low, high = time_ends(df, time)
    ends = df.where(F.col(time).isin(low, high)).select(cluster, (F.col(time) == high).cast("int").alias("__end"), F.col(value).cast("double").alias("__v"))
    at = lambda end, c: F.when(F.col("__end") == end, F.col(c))
    plain = ends.groupBy(cluster).agg(F.avg(at(0, "__v")).alias("mean_fraction_earliest"), F.avg(at(1, "__v")).alias("mean_fraction_latest"), F.count(at(0, "__v")).alias("n_images_earliest"), F.count(at(1, "__v")).alias("n_images_latest"))
    sums = bootstrap.resampled_sums(ends, [cluster, "__end"], "__v", draws, seed)
    mean = F.col("sum") / F.col("n")
    change = sums.groupBy(cluster, "draw").agg((F.max(F.when(F.col("__end") == 1, mean)) - F.max(F.when(F.col("__end") == 0, mean))).alias("__change"))
    q = change.groupBy(cluster).agg(F.percentile("__change", [0.025, 0.975]).alias("__q"))  # a row a draw
    out = join_on(plain, q, [cluster], "left")
    return out.select(
        cluster, F.lit(low).alias("earliest_time_hours"), F.lit(high).alias("latest_time_hours"), "mean_fraction_earliest", "mean_fraction_latest", (F.col("mean_fraction_latest") - F.col("mean_fraction_earliest")).alias("change_latest_minus_earliest"),
        F.get("__q", F.lit(0)).alias("bootstrap_ci_lower"), F.get("__q", F.lit(1)).alias("bootstrap_ci_upper"), "n_images_earliest", "n_images_latest",
    )
