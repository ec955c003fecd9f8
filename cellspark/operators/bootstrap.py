"""Resampled means of groups of any size: draws are split among chunks of a group's sorted values and summed by Spark."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from .quantiles import counted
from .tables import join_on

#: Values of a group that one task draws from at a time.
CHUNK = 4096
_BLOCK = 1 << 20


def own_seed(seed: int, *values) -> list[int]:
    """A seed of its own for each group, so that no two draw the same."""
    return [seed, zlib.crc32(repr([str(v) for v in values]).encode())]


def chunk_draws(n: int, chunk: int, k: int, draws: int, seed: list[int]) -> np.ndarray:
    """How many of each draw's n values fall into chunk k of n places: halves are dealt binomially from the whole down."""
    low, high = 0, -(-n // chunk)
    counts = np.full(draws, n, np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([*seed, low, high]).binomial(counts, (mid - low) * chunk / (min(n, high * chunk) - low * chunk))
        counts, low, high = (left, low, mid) if k < mid else (counts - left, mid, high)
    return counts


def chunk_sums(values: np.ndarray, counts: np.ndarray, k: int, seed: list[int]) -> np.ndarray:
    """For each draw the sum of so many values, drawn from the chunk with replacement."""
    rng, out, step = np.random.default_rng([*seed, k]), [], max(1, _BLOCK // max(1, len(values)))
    for at in range(0, len(counts), step):
        ends = np.cumsum(counts[at : at + step])
        done = np.concatenate(([0.0], np.cumsum(values[rng.integers(0, len(values), ends[-1])])))
        out.append(done[ends] - done[np.concatenate(([0], ends[:-1]))])
    return np.concatenate(out)


def resampled_sums(df: DataFrame, keys: list[str], value: str, draws: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """(keys, draw, sum, n): of each group's n finite values, n drawn with replacement, ``draws`` times.

    Draws depend on the group's values, its keys and the seed alone.  A task takes ``chunk`` places of a group;
    a frequent value may span several.
    """
    kinds = dict(df.dtypes)
    values = counted(df.where(E.finite(value)).select(*keys, F.col(value).cast("double").alias("__v")), "__v", *keys)
    first, last = F.floor(F.col("below") / chunk), F.floor((F.col("below") + F.col("n") - 1) / chunk)
    parts = values.withColumn("__chunk", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    times = F.least(F.col("below") + F.col("n"), (F.col("__chunk") + 1) * chunk) - F.greatest(F.col("below"), F.col("__chunk") * chunk)
    parts = parts.select(*keys, "__chunk", "__v", times.alias("__times"), "total")

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("__v")
        n, k, own = int(rows["total"].iloc[0]), int(rows["__chunk"].iloc[0]), own_seed(seed, *rows[keys].iloc[0])
        got = chunk_sums(np.repeat(rows["__v"].to_numpy(), rows["__times"].to_numpy()), chunk_draws(n, chunk, k, draws, own), k, own)
        out = pd.DataFrame({"draw": np.arange(draws), "__k": k, "sum": got, "n": n})
        for i, c in enumerate(keys):
            out.insert(i, c, rows[c].iloc[0])
        return out

    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "draw int, __k int, sum double, n long"
    each = parts.groupBy(*keys, "__chunk").applyInPandas(draw, schema)
    # chunks' sums in their order, so that the last bits don't depend on the run
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("__k", "sum"))), F.lit(0.0), lambda a, x: a + x["sum"])
    return each.groupBy(*keys, "draw", "n").agg(whole.alias("sum")).select(*keys, "draw", "sum", "n")


def means(df: DataFrame, keys: list[str], value: str, draws: int = 2000, seed: int = 43, chunk: int = CHUNK) -> DataFrame:
    """(keys, n_images, mean, ci_lower, ci_upper): the mean, and 2.5 and 97.5 percentiles of resampled means, of each group.

    Groups draw independently.  Values that are not finite don't count; a group without others has NULLs.
    """
    plain = df.groupBy(*keys).agg(F.count_if(E.finite(value)).alias("n_images"), F.avg(F.when(E.finite(value), F.col(value))).alias("mean"))
    q = resampled_sums(df, keys, value, draws, seed, chunk).groupBy(*keys).agg(F.percentile(F.col("sum") / F.col("n"), [0.025, 0.975]).alias("__q"))  # a row a draw
    return join_on(plain, q, keys, "left").select(*keys, "n_images", "mean", F.get("__q", F.lit(0)).alias("ci_lower"), F.get("__q", F.lit(1)).alias("ci_upper"))
