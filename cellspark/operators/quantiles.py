"""Exact ranks and quantiles without a task that sees all values.

Ranks: distinct values are dealt by ranges, as many as the data need, and the counts of
earlier ranges are added.  Quantiles: approximate ones bracket each place, rows are counted
below and inside the bracket, and it is narrowed until what lies inside is few; no values are shuffled but those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import join_on, written

#: Relative error of the approximate quantiles is 1 in so many; a bracket is twice as far on both sides.
ACCURACY = 2000
#: Values strictly inside a bracket that are then ordered.
MOST = 100_000


def counted(df: DataFrame, value: str, *keys: str, weight: Column | None = None) -> DataFrame:
    """(keys, value, n, below, total): how often each value occurs, how many rows lie under it, and all rows of its key.

    With ``weight`` (whole numbers) rows count as often as it says.  NULL values don't count; NULL keys are a key.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    # the ranges are kept with the rows: dealt anew, they might be others
    ranges = written(n.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    sizes = ranges.groupBy(*keys, "__range").agg(F.sum("n").alias("__size"))
    sizes = sizes.select(*keys, "__range", (F.sum("__size").over(whole.orderBy("__range")) - F.col("__size")).alias("__before"), F.sum("__size").over(whole).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*keys, "__range").orderBy(value)) - F.col("n")
    out = join_on(ranges.withColumn("__within", within), sizes, [*keys, "__range"])
    return out.select(*keys, value, "n", (F.col("__before") + F.col("__within")).alias("below"), "total")


def value_ranks(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, n, rank): average rank of each distinct value."""
    return counted(df, value, *keys).select(*keys, value, "n", (F.col("below") + (F.col("n") + 1) / 2).alias("rank"))


def _places(shares: list[float]) -> list[Column]:
    return [p * (F.col("__n") - 1) for p in shares]


def _each(f, n: int) -> Column:
    return F.array(*(f(i) for i in range(n)))


def _brackets(rows: DataFrame, shares: list[float], keys: tuple[str, ...]) -> DataFrame:
    """(keys, __n, __low, __high): a bracket around each place, the least and greatest value at the ends."""
    step, n = 2 / ACCURACY, len(shares)
    near = [max(0.0, p - step) for p in shares] + [min(1.0, p + step) for p in shares]
    q = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"), F.percentile_approx("__v", near, ACCURACY).alias("__q"))
    low = _each(lambda i: F.col("__least") if near[i] <= 0 else F.get("__q", i), n)
    high = _each(lambda i: F.col("__most") if near[n + i] >= 1 else F.get("__q", n + i), n)
    return q.select(*keys, "__n", "__least", "__most", low.alias("__low"), high.alias("__high"))


def _measured(rows: DataFrame, state: DataFrame, shares: list[float], keys: tuple[str, ...]) -> DataFrame:
    """``state`` with the rows below each bracket, on its lower end, strictly inside and on its upper end."""
    both, v = join_on(rows, state, keys), F.col("__v")
    low, high = (lambda i: F.get("__low", i)), (lambda i: F.get("__high", i))
    count = {"__under": lambda i: v < low(i), "__on_low": lambda i: v == low(i), "__inside": lambda i: (v > low(i)) & (v < high(i)), "__on_high": lambda i: (v == high(i)) & (high(i) > low(i))}
    flat = both.groupBy(*keys, *(c for c in state.columns if c not in keys)).agg(*(F.count_if(f(i)).alias(f"{name}_{i}") for name, f in count.items() for i in range(len(shares))))
    return flat.select(*state.columns, *(_each(lambda i, m=name: F.col(f"{m}_{i}"), len(shares)).alias(name) for name in count))


def _held(i: int, place: Column) -> Column:
    """Whether both neighbours of the place lie in the bracket."""
    under = F.get("__under", i)
    return (under <= F.floor(place)) & (F.ceil(place) < under + F.get("__on_low", i) + F.get("__inside", i) + F.get("__on_high", i))


def _narrowed(rows: DataFrame, state: DataFrame, shares: list[float], keys: tuple[str, ...], most: int) -> DataFrame:
    """Brackets that hold too much are bracketed again from what is inside; one that misses its place begins again with all values."""
    places, n = _places(shares), len(shares)
    wide = [_held(i, p) & (F.get("__inside", i) > most) for i, p in enumerate(places)]
    v = F.col("__v")
    both = join_on(rows, state.select(*keys, "__low", "__high", *(w.alias(f"__wide_{i}") for i, w in enumerate(wide))), keys)
    inside = [F.when(F.col(f"__wide_{i}") & (v >= F.get("__low", i)) & (v <= F.get("__high", i)), v) for i in range(n)]
    grid = [k / 64 for k in range(65)]
    found = both.groupBy(*keys).agg(*(F.percentile_approx(x, grid, ACCURACY).alias(f"__q_{i}") for i, x in enumerate(inside)))
    state = join_on(state, found, keys, "left")
    low, high = [], []
    for i, p in enumerate(places):
        size = F.get("__on_low", i) + F.get("__inside", i) + F.get("__on_high", i)
        at = lambda more: (p - F.get("__under", i) + more) / size * 64  # noqa: B023, E731
        q, down, up = F.col(f"__q_{i}"), (F.floor(at(-1)) - 1).cast("int"), (F.ceil(at(2)) + 1).cast("int")
        low.append(F.when(wide[i], F.when(down < 0, F.get("__low", i)).otherwise(F.get(q, F.greatest(down, F.lit(0))))).when(_held(i, p), F.get("__low", i)).otherwise(F.col("__least")))
        high.append(F.when(wide[i], F.when(up > 64, F.get("__high", i)).otherwise(F.get(q, F.least(up, F.lit(64))))).when(_held(i, p), F.get("__high", i)).otherwise(F.col("__most")))
    return state.select(*keys, "__n", "__least", "__most", F.array(*low).alias("__low"), F.array(*high).alias("__high"))


_MEASURES = ("__low", "__high", "__under", "__on_low", "__inside", "__on_high")


def _better(before: DataFrame, after: DataFrame, shares: list[float], keys: tuple[str, ...]) -> DataFrame:
    """The new brackets, but the old one where the new one misses its place; ``__moved`` tells whether any is new."""
    fits = after.select(*keys, *(F.col(c).alias(f"__new{c}") for c in _MEASURES), *(_held(i, p).alias(f"__fits_{i}") for i, p in enumerate(_places(shares))))
    both = join_on(before, fits, keys)
    pick = {c: _each(lambda i, c=c: F.when(F.col(f"__fits_{i}"), F.get(f"__new{c}", i)).otherwise(F.get(c, i)), len(shares)) for c in _MEASURES}
    return both.select(*keys, "__n", "__least", "__most", *(x.alias(c) for c, x in pick.items()), ((pick["__low"] != F.col("__low")) | (pick["__high"] != F.col("__high"))).alias("__moved"))


def quantiles(df: DataFrame, value: str, shares: list[float], *keys: str, most: int = MOST) -> DataFrame:
    """(keys, q): exact quantiles with linear interpolation, as ``percentile`` gives them, as an array.

    A key without values has no row, NULL is a key like others; without keys there is always one row, of NULLs if empty.
    ``df`` is read once for the brackets, once to count and once for what is inside, and twice for
    each time that brackets have to be narrowed: about once for each factor of 15 in rows beyond 50 million a key.
    """
    n = len(shares)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    state = written(_measured(rows, written(_brackets(rows, shares, keys)), shares, keys))
    while True:
        fine = [_held(i, p) & (F.get("__inside", i) <= most) for i, p in enumerate(_places(shares))]
        if state.where(~F.forall(F.array(*fine), lambda x: x)).isEmpty():
            break
        after = written(_measured(rows, written(_narrowed(rows, state, shares, keys, most)), shares, keys))
        better = written(_better(state, after, shares, keys))
        state = better.drop("__moved")
        if better.where("__moved").isEmpty():  # few distinct values, each of many rows
            break
    v = F.col("__v")
    near = join_on(rows, state.select(*keys, "__n", "__low", "__high", "__under"), keys)
    of = F.array(*(F.when((v >= F.get("__low", i)) & (v <= F.get("__high", i)), F.struct(F.lit(i).alias("i"), F.get("__under", i).alias("under"))) for i in range(n)))
    near = near.select(*keys, "__n", "__v", F.explode(F.array_compact(of)).alias("__b")).select(*keys, "__n", "__v", F.col("__b.i").alias("__i"), F.col("__b.under").alias("__under"))
    near = near.groupBy(*keys, "__i", "__v", "__n", "__under").agg(F.count("*").alias("__k"))
    to = F.col("__under") + F.sum("__k").over(Window.partitionBy(*keys, "__i").orderBy("__v"))
    near = near.withColumn("__to", to).withColumn("__from", F.col("__to") - F.col("__k"))
    parts = []
    for i, place in enumerate(_places(shares)):
        value_at = lambda r: F.max(F.when((F.col("__i") == i) & (F.col("__from") <= r) & (r < F.col("__to")), v))  # noqa: B023, E731
        parts += [value_at(F.floor(place)).alias(f"__a{i}"), value_at(F.ceil(place)).alias(f"__b{i}"), F.max(place - F.floor(place)).alias(f"__f{i}")]
    out = near.groupBy(*keys).agg(*parts)
    q = _each(lambda i: F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}"), n)
    return out.select(*keys, q.alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float], *keys: str) -> DataFrame:
    """(keys, an array of quantiles for each column, under its name), all columns and keys at once; one row where there are no keys."""
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    q = quantiles(df.select(*keys, pairs.alias("__x")).select(*keys, F.col("__x.i").alias("__column"), F.col("__x.v").alias("__value")), "__value", shares, *keys, "__column")
    return q.groupBy(*keys).agg(*(F.max(F.when(F.col("__column") == i, F.col("q"))).alias(c) for i, c in enumerate(columns)))  # a row a column before


def medians(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, the exact median of each column under its name): groups of any size; NULL where a column has no values, and no row where none has."""
    return column_quantiles(df, columns, [0.5], *keys).select(*keys, *(F.get(c, F.lit(0)).alias(c) for c in columns))
