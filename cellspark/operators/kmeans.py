"""K-means of many starts, and of many weighted resamples, in one pass over the rows for each step of all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Distinct rows that first centres are chosen from, by weight: a seeded sample of bounded size.  All rows take part in every step after.
FIRST_ROWS = 10_000
STEPS, MOVED = 50, 1e-4
_BLOCK = 4096


def first_centres(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows: each is drawn by its weight times its squared distance to those before."""
    at = [int(rng.choice(len(x), p=w / w.sum()))]
    near = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:
        p = w * near
        at.append(int(rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else w / w.sum())))
        near = np.minimum(near, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest of ``centres`` (..., k, d) for each row, its squared distance), each of shape (rows, ...)."""
    flat = centres.reshape(-1, centres.shape[-1])
    d = ((x**2).sum(1)[:, None] - 2 * x @ flat.T + (flat**2).sum(1)).reshape(len(x), *centres.shape[:-1])
    return d.argmin(-1), np.maximum(d.min(-1), 0.0)


def sums(x: np.ndarray, w: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each (refit, start, cluster) of ``centres``: weighted sums of the columns, weight, weighted squared distances."""
    refits, starts, k, d = centres.shape
    out = np.zeros((refits, starts, k, d + 2))
    for at in range(0, len(x), _BLOCK):
        xs = x[at : at + _BLOCK]
        for r in range(refits):
            ws = w[at : at + _BLOCK, r]
            own, dist = nearest(xs, centres[r])
            both = np.concatenate((xs * ws[:, None], ws[:, None]), 1)
            for j in range(k):
                mine = (own == j).astype(float)
                out[r, :, j, : d + 1] += mine.T @ both
                out[r, :, j, d + 1] += (mine * dist).T @ ws
    return out


def _pass(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((*centres.shape[:-1], centres.shape[-1] + 2))
        for b in batches:
            if len(b):
                total += sums(np.stack(b["x"]), np.stack(b["w"]), centres)
        yield pd.DataFrame({"refit": np.arange(len(total)), "part": TaskContext.get().partitionId(), "sums": [t.tobytes() for t in total]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(s) for s in part.sort_values("part")["sums"])
        return pd.DataFrame({"refit": part["refit"].iloc[:1], "part": 0, "sums": [whole.tobytes()]})

    schema = "refit int, part int, sums binary"
    got = rows.mapInPandas(task, schema).groupBy("refit").applyInPandas(add, schema).collect()  # sums of each refit's clusters
    shape = (*centres.shape[1:-1], centres.shape[-1] + 2)
    return np.stack([np.frombuffer(r["sums"]).reshape(shape) for r in sorted(got, key=lambda r: r["refit"])])


def fit(rows: DataFrame, k: int, starts: int, seed: int, steps: int = STEPS, refits: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(centres of the best start of each refit, their weighted squared distances).

    ``rows`` has x (array of doubles) and w (array of a weight a refit).  Equal rows are one of their summed weight, so that a
    sample of first centres holds as many different ones as there are; what is left is written, and each step reads it
    once, for all starts of all refits.  A cluster that gets no row keeps its centre.
    """
    rows = written(rows.groupBy("x").agg(F.array(*(F.sum(F.get("w", F.lit(r))) for r in range(refits))).alias("w")))
    sample = rows.orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(FIRST_ROWS).toPandas()
    x, w = np.stack(sample["x"]), np.stack(sample["w"])
    centres = np.stack([np.stack([first_centres(x, w[:, r] if w[:, r].sum() > 0 else np.ones(len(x)), k, np.random.default_rng([seed, r, s])) for s in range(starts)]) for r in range(refits)])
    for _ in range(steps):
        got = _pass(rows, centres)
        n = got[..., -2:-1]
        after = np.where(n > 0, got[..., :-2] / np.maximum(n, 1e-300), centres)
        moved = np.sqrt(((after - centres) ** 2).sum(-1)).max()
        centres = after
        if moved <= MOVED:
            break
    cost = _pass(rows, centres)[..., -1].sum(-1)
    best = cost.argmin(1)
    r = np.arange(refits)
    return centres[r, best], cost[r, best]


def label(rows: DataFrame, x: str, centres: np.ndarray, name: str = "prediction") -> DataFrame:
    """``rows`` with the number of the nearest centre."""

    @F.pandas_udf("int")
    def at(v: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(v), centres)[0].astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    return rows.withColumn(name, at(x))


def contingency(rows: DataFrame, label_column: str, centres: np.ndarray, times: str | None = None) -> DataFrame:
    """(refit, label, prediction, n): how often each label meets each cluster of each refit's ``centres``, in one pass.

    A row counts once, or as often as its column ``times`` says.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                own = nearest(np.stack(b["x"]), centres)[0]
                for r in range(len(centres)):
                    met = pd.DataFrame({"label": b[label_column], "prediction": own[:, r], "n": b[times] if times else 1})
                    n = met.groupby(["label", "prediction"], as_index=False)["n"].sum()
                    yield n.assign(refit=r)[["refit", "label", "prediction", "n"]]

    kind = dict(rows.dtypes)[label_column]
    return rows.mapInPandas(task, f"refit int, label {kind}, prediction int, n long").groupBy("refit", "label", "prediction").agg(F.sum("n").alias("n"))
