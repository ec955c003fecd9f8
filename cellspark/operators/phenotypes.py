"""Phenotypes with pyspark.ml: PCA, K-means, silhouette, choice of the number of clusters."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kmeans, stats
from .quantiles import quantiles
from .tables import written


def spread(df: DataFrame, array: str, n: int) -> DataFrame:
    """The first n items of an array as double columns f0, f1, ..."""
    return df.withColumns({f"f{i}": F.col(array)[i].cast("double") for i in range(n)})


def scaled_vector(df: DataFrame, columns: list[str], center: bool = False) -> DataFrame:
    """Robustly scaled columns as the vector ``features``; centred on means for PCA."""
    out = df.withColumns(stats.scaling(df, columns))
    names = [f"{c}_scaled" for c in columns]
    if center:
        means = out.agg(*(F.avg(c) for c in names)).first()
        out = out.withColumns({c: F.col(c) - F.lit(m) for c, m in zip(names, means, strict=True)})
    return VectorAssembler(inputCols=names, outputCol="features").transform(out)


def pca(df: DataFrame, columns: list[str]):
    """(rows with PC1 ..., loadings, variance ratios): components signed so that the largest loading is positive."""
    vectors = scaled_vector(df, columns, center=True)
    model = PCA(k=len(columns), inputCol="features", outputCol="pc").fit(vectors)
    loads = model.pc.toArray()
    sign = np.sign(loads[np.abs(loads).argmax(0), range(loads.shape[1])])
    scores = model.transform(vectors).withColumn("pc", vector_to_array("pc"))
    scores = scores.withColumns({f"PC{i + 1}": F.col("pc")[i] * float(sign[i]) for i in range(len(columns))}).drop("pc", "features")
    return scores, loads * sign, model.explainedVariance.toArray()


def pca_variance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(principal_component, explained_variance_ratio, cumulative_explained_variance)."""
    _, _, share = pca(df, columns)
    rows = [(i + 1, f"PC{i + 1}", float(x)) for i, x in enumerate(share)]
    out = df.sparkSession.createDataFrame(rows, "i int, principal_component string, explained_variance_ratio double")
    total = F.sum("explained_variance_ratio").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("cumulative_explained_variance", total).drop("i")


def fit_clusters(df: DataFrame, columns: list[str], k: int, restarts: int = 20, seed: int = 42, order_by: str = "area") -> tuple[DataFrame, float]:
    """(rows with phenotype_cluster, inertia): K-means, the best of several starts, which share each pass over the rows; clusters renumbered 1 ... k by ascending median of ``order_by``."""
    scaled = df.withColumns(stats.scaling(df, columns))
    x = F.array(*(F.col(f"{c}_scaled") for c in columns))
    centres, cost = kmeans.fit(scaled.select(x.alias("x"), F.array(F.lit(1.0)).alias("w")), k, restarts, seed)
    raw = written(kmeans.label(scaled.withColumn("__x", x), "__x", centres[0]).drop("__x"))
    medians = quantiles(raw, order_by, [0.5], "prediction")
    names = medians.select("prediction", F.row_number().over(Window.orderBy(F.get("q", F.lit(0)), "prediction")).alias("phenotype_cluster"))  # k rows
    return raw.join(F.broadcast(names), "prediction").drop("prediction"), float(cost[0])


def cluster(df: DataFrame, columns: list[str], k: int, restarts: int = 20, seed: int = 42, order_by: str = "area") -> DataFrame:
    return fit_clusters(df, columns, k, restarts, seed, order_by)[0]


def silhouette(df: DataFrame, columns: list[str], label: str, key: str, sample: int = 10_000, seed: int = 42) -> float:
    """Mean Euclidean silhouette over at most ``sample`` rows, chosen by a seeded hash.

    The sample is bounded, so it goes to every task; distances are taken in blocks.
    """
    rows = df.select(key, label, *columns).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(sample)
    held = rows.toPandas()
    x, y = held[columns].to_numpy(float), held[label].to_numpy()
    names = np.unique(y)
    if len(names) < 2:
        return 0.0

    def task(batches):
        for b in batches:
            mine, own = b[columns].to_numpy(float), b[label].to_numpy()
            sums = np.zeros((len(mine), len(names)))
            for i in range(0, len(mine), 64):  # 64 rows against the sample at a time
                d = np.sqrt(sum((mine[i : i + 64, None, k] - x[None, :, k]) ** 2 for k in range(len(columns))))
                sums[i : i + 64] = np.stack([d[:, y == n].sum(1) for n in names], 1)
            size = np.array([(y == n).sum() for n in names])
            at = np.searchsorted(names, own)
            r = np.arange(len(mine))
            a = sums[r, at] / np.maximum(size[at] - 1, 1)
            other = sums / size
            other[r, at] = np.inf
            low = other.min(1)
            s = np.where(size[at] > 1, (low - a) / np.maximum(np.maximum(a, low), 1e-300), 0.0)
            yield pd.DataFrame({"s": s})

    return rows.repartition(8).mapInPandas(task, "s double").agg(F.avg("s")).first()[0]


def select_k(df: DataFrame, columns: list[str], key: str, order_by: str, most: int = 6, restarts: int = 20) -> tuple[int, list[tuple[int, float, float]]]:
    """The number of clusters (2 ... most) of the highest silhouette, the smallest of equals, and (k, silhouette, inertia) of each."""
    n = df.count()
    if n < 3:
        raise ValueError("too few cells to choose a number of clusters")
    names, found = [f"{c}_scaled" for c in columns], []
    for k in range(2, min(most, n - 1) + 1):
        rows, inertia = fit_clusters(df, columns, k, restarts, order_by=order_by)
        found.append((k, silhouette(rows, names, "phenotype_cluster", key), inertia))
    return max(found, key=lambda x: (x[1], -x[0]))[0], found


def loadings(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, PC1, ...): what each scaled column gives to each component."""
    _, loads, _ = pca(df, columns)
    rows = [(c, *map(float, loads[i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "feature string" + "".join(f", PC{i + 1} double" for i in range(len(columns))))


def align(centres: np.ndarray, reference: np.ndarray) -> list[int]:
    """For each centre the reference it goes to: least summed distance over all permutations (k is at most 6)."""
    d = np.sqrt(((centres[:, None] - reference[None]) ** 2).sum(2))
    return list(min(itertools.permutations(range(len(reference))), key=lambda p: sum(d[i, j] for i, j in enumerate(p))))
