"""Packing of tokenised documents into windows: counts of shallow combinations by non-negative least squares, the rest greedily."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stash

WINDOW = 4096
#: Token that ends each document.
END = 2
#: Lengths are dealt into so many bins; combinations fill all of them.
UNITS = 256
#: Distinct words whose ids a worker remembers at once.
CACHE = 500_000
#: Bytes of text that are looked up at once (a longer document stands alone).
BLOCK_BYTES = 1 << 23
#: Letters after which a full stop and the like may be parted from the word (not one whose lower case ends with a mark).
_PARTED = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{400}-\x{481}\x{48A}-\x{4FF}])([.,;:!?)]+)(\s|$)"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Token ids of texts by way of their distinct words, for a tokenizer that drops white space between words.

    No token spans white space, so that the ids of a text are those of its parts; each part is
    encoded once and remembered, ``CACHE`` at most.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.machine = Tokenizer.from_file(path)
        vocabulary = self.machine.get_vocab()
        self.small = max(vocabulary.values()) < 1 << 16
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.pool, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.machine.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids side by side, and how many each has.  Words of letters are encoded together: each ends with a token that ends a word."""
        plain = [w for w in new if w.isalpha()]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(x, np.uint32) for x in self._encode([" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]))])
        cut = np.flatnonzero(self.ends[flat]) + 1
        if len(cut) == len(plain):
            sizes = dict(zip(plain, np.diff(cut, prepend=0).tolist(), strict=True))
            at = dict(zip(plain, np.concatenate(([0], cut[:-1])).tolist() if plain else [], strict=True))
        else:
            sizes = at = {}
        rest = [w for w in new if w not in sizes]
        found = dict(zip(rest, self._encode(rest), strict=True))
        parts = [found[w] if w in found else flat[at[w] : at[w] + sizes[w]] for w in new]
        return np.concatenate([np.zeros(0, np.uint32), *(np.asarray(p, np.uint32) for p in parts)]), np.array([len(p) for p in parts], np.int64)

    def _remember(self, new: list[str]) -> None:
        ids, size = self._ids(new)
        n, total = len(self.known), len(self.known) + len(new)
        if total > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * total), np.resize(self.size, 2 * total)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * (self.used + len(ids)))
        self.first[n:total], self.size[n:total] = self.used + np.concatenate(([0], np.cumsum(size)[:-1])), size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(new, range(n, total), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side and the n + 1 offsets of the texts; null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _PARTED, r"\1 \2\3"))
        once = parts.values.dictionary_encode()
        word = once.dictionary
        plain = pc.and_(pc.string_is_ascii(word), pc.invert(pc.match_substring(word, "<|")))  # signs of special tokens have a case
        lower = pc.if_else(plain, pc.ascii_lower(word), word).dictionary_encode()
        names = lower.dictionary.to_pylist()
        if len(self.known) + len(names) > CACHE:
            self.forget()
        if new := [w for w in names if w not in self.known]:
            self._remember(new)
        number = np.array([self.known[w] for w in names], np.int64)[lower.indices.to_numpy()][once.indices.to_numpy()] if names else np.zeros(0, np.int64)
        first, size = self.first[number], self.size[number]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(first - done[:-1], size) + np.arange(done[-1])]
        return ids, done[parts.offsets.to_numpy() - parts.offsets[0].as_py()]


@cache
def _words(path: str) -> Words:
    return Words(path)


def combinations(units: int) -> np.ndarray:
    """Every two or three bins that fill ``units``, in falling order; 0 where there are two.

    A third bin is 2 at least: what the first two exceed their bins by must not fill the window.
    """
    a, b = np.meshgrid(np.arange(units + 1), np.arange(units + 1), indexing="ij")
    c = units - a - b
    keep = (a >= b) & (b >= c) & (c >= 0) & (c != 1) & (a < units)
    return np.stack((a[keep], b[keep], c[keep]), axis=1)


def non_negative_least_squares(columns: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises the squares of A x - ``wanted`` by an active set; column j of A counts the bins in row j of ``columns``."""
    m, units = len(columns), len(wanted)
    x, inside = np.zeros(m), np.zeros(m, bool)
    rest = wanted.astype(float).copy()
    rest[0] = 0.0
    least = 1e-9 * max(1.0, float(rest.max(initial=0)))

    def matrix(some: np.ndarray) -> np.ndarray:
        a = np.zeros((units, len(some)))
        for slot in range(3):
            np.add.at(a, (columns[some, slot], np.arange(len(some))), 1.0)
        a[0] = 0.0
        return a

    target = rest.copy()
    for _ in range(6 * units):
        gain = np.where(inside, -np.inf, rest[columns].sum(axis=1))
        best = int(gain.argmax()) if m else 0
        if not m or gain[best] <= least:
            break
        inside[best] = True
        while True:
            some = np.flatnonzero(inside)
            a = matrix(some)
            try:
                s = np.linalg.solve(a.T @ a, a.T @ target)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(a, target, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[some] = s
                break
            low = s <= 0
            step = float((x[some][low] / np.maximum(x[some][low] - s[low], 1e-300)).min())
            x[some] += step * (s - x[some])
            inside[some[(x[some] <= 1e-12 * max(1.0, float(x.max()))) & low]] = False
            x[~inside] = 0
            if not inside.any():
                break
        rest = target - matrix(np.flatnonzero(inside)) @ x[inside]
    return x


def repeats(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(bins, how often) of the combinations to pack, from counts of pieces by bin: rounded, and never more than there are."""
    units = len(histogram)
    used = np.flatnonzero(histogram)
    columns = combinations(units)
    columns = columns[np.isin(columns, np.append(used, 0)).all(axis=1)]
    x = non_negative_least_squares(columns, histogram)
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        bins = tuple(int(b) for b in columns[j] if b)
        times = min(round(float(x[j])), *(int(left[b]) // bins.count(b) for b in bins))
        if times > 0:
            for b in bins:
                left[b] -= times
            out.append((bins, times))
    return out


class Plan:
    """Which window and slot the n-th piece of a bin takes; -1 is none."""

    def __init__(self, histogram: np.ndarray):
        ranges: list[list[tuple[int, int, int]]] = [[] for _ in histogram]
        taken, self.windows = [0] * len(histogram), 0
        for bins, times in repeats(histogram):
            for slot, b in enumerate(bins):
                ranges[b].append((taken[b], self.windows, slot))
                taken[b] += times
            self.windows += times
        self.taken = np.array(taken, np.int64)
        self.ranges = [np.array(r, np.int64).reshape(-1, 3) for r in ranges]

    def place(self, bins: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        window, slot = np.full(len(bins), -1, np.int64), np.zeros(len(bins), np.int32)
        for b in np.unique(bins):
            at = np.flatnonzero((bins == b) & (rank < (self.taken[b] if b < len(self.taken) else 0)))
            if len(at):
                r = self.ranges[b]
                k = np.searchsorted(r[:, 0], rank[at], "right") - 1
                window[at], slot[at] = r[k, 1] + rank[at] - r[k, 0], r[k, 2]
        return window, slot


_PIECES = "part int, row long, start long, length int, bin int, nth long, crc long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, path: str, window: int, units: int, end: int, key: str = "doc_id", text: str = "text", keep: bool = True) -> DataFrame:
    """Documents as ids, cut into pieces of ``window`` ids and one that is shorter; ``nth`` counts pieces of a bin within a part.

    Whole windows are in bin ``units`` and keep their ids only if ``keep``.
    """
    unit = window // units

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, part, row = _words(path), TaskContext.get().partitionId(), 0
        seen = np.zeros(units + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                ids, off = machine.encode(texts.slice(at, to - at))
                n = np.diff(off) + 1
                ids = np.insert(ids, off[1:], end).astype("<u4")
                first = np.concatenate(([0], np.cumsum(n)[:-1]))
                many = -(-n // window)
                doc = np.repeat(np.arange(len(n)), many)
                k = np.arange(len(doc)) - np.repeat(np.concatenate(([0], np.cumsum(many)[:-1])), many)
                start = k * window
                length = np.minimum(window, n[doc] - start)
                begin = (first[doc] + start).tolist()
                parts = [ids[a : a + m] for a, m in zip(begin, length.tolist(), strict=True)]
                bins = length // unit if unit else length
                order = np.argsort(bins, kind="stable")
                inner = np.empty(len(bins), np.int64)
                inner[order] = np.arange(len(bins)) - np.searchsorted(bins[order], bins[order])
                nth = seen[bins] + inner
                seen += np.bincount(bins, minlength=units + 1)
                kind = "<u2" if machine.small else "<u4"
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at).take(pa.array(doc)), pa.array(np.full(len(doc), part, np.int32)), pa.array(row + np.arange(len(doc))), pa.array(start), pa.array(length.astype(np.int32)), pa.array(bins.astype(np.int32)),
                        pa.array(nth), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(n[doc]), pa.array([p.astype(kind).tobytes() if keep or len(p) < window else None for p in parts], pa.binary()),
                    ],
                    names,
                )
                row += len(doc)
                at = to

    names = ["__key", *(c.split()[0] for c in _PIECES.split(", "))]
    return docs.select(key, F.col(text).cast("string")).mapInArrow(task, f"__key {docs.schema[key].dataType.simpleString()}, {_PIECES}")


def _before(df: DataFrame, part: str, value: str) -> DataFrame:
    """``df`` (a row a part) with the sum of ``value`` over earlier parts: sums of a thousand parts, then within them."""
    df = df.withColumn("__group", F.floor(F.col(part) / 1000))
    groups = df.groupBy("__group").agg(F.sum(value).alias("__sum"))
    groups = groups.select("__group", (F.sum("__sum").over(Window.orderBy("__group")) - F.col("__sum")).alias("__earlier"))
    within = F.sum(value).over(Window.partitionBy("__group").orderBy(part)) - F.col(value)
    return df.join(groups, "__group").withColumn("before", F.col("__earlier") + within).drop("__group", "__earlier")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, units: int = UNITS, end: int = END, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """A row for each piece of a document: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``keep_ids``, ids.

    The ids of a text (null: none) and ``end`` are cut into windows; the last piece of each document, by
    its length in ``units`` bins rounded down, goes to a combination of up to three bins that
    fill a window, as often as least squares over all counts say.  What stands over the
    window's end, less than a bin for each piece, is cut off the last piece; these ends and the pieces that the
    rounded counts leave follow each other, cut at the windows' ends, in further windows.  All of them
    are full, and the last ids are dealt to sequences whose lengths are falling powers of two, which need no padding either.
    ``window`` must be a power of two and a multiple of ``units``.  Every document has a piece at least (that of ``end``); keys may be null or
    repeat, a row is a document.  Further columns are ignored; an empty table gives an empty one.
    """
    if window % units or window & (window - 1):
        raise ValueError("the window must be a power of two and a multiple of the bins")
    path = path or tokenizer_path()
    cut = stash(pieces(docs, path, window, units, end, key, text, keep_ids))
    counts = cut.groupBy("part", "bin").agg(F.count("*").alias("n"))
    histogram = np.zeros(units + 1, np.int64)
    for b, n in counts.groupBy("bin").agg(F.sum("n")).collect():  # a number a bin
        histogram[b] = n
    plan = Plan(histogram[:units])

    @F.pandas_udf("window long, slot int")
    def place(bins: pd.Series, rank: pd.Series) -> pd.DataFrame:
        w, s = plan.place(bins.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"window": w, "slot": s})

    earlier = counts.select("part", "bin", (F.sum("n").over(Window.partitionBy("bin").orderBy("part")) - F.col("n")).alias("earlier"))
    light = cut.drop("ids").join(earlier, ["part", "bin"]).withColumn("rank", F.col("nth") + F.col("earlier")).drop("nth", "earlier")
    placed = stash(light.withColumn("at", place("bin", "rank")).select("*", "at.window", "at.slot").drop("at"))
    full, joined, left = (placed.where(w) for w in (f"bin = {units}", f"bin < {units} and window >= 0", f"bin < {units} and window < 0"))
    gone = F.sum("length").over(Window.partitionBy("window").orderBy("slot")) - F.col("length")
    joined = stash(joined.withColumn("offset", gone).withColumn("from", F.lit(0)).withColumn("head", F.least("length", F.lit(window) - F.col("offset"))))
    tails = joined.where("head < length").withColumns({"from": F.col("head"), "size": F.col("length") - F.col("head")})
    carried = ["__key", "part", "row", "start", "length", "crc", "doc_tokens", "from", "size"]
    stream = tails.select(*carried).union(left.withColumns({"from": F.lit(0), "size": F.col("length")}).select(*carried))
    sums = stream.groupBy("part").agg(F.sum("size").alias("all"))
    in_part = F.sum("size").over(Window.partitionBy("part").orderBy("row")) - F.col("size")
    stream = stash(stream.withColumn("inner", in_part).join(_before(sums, "part", "all").select("part", "before"), "part").withColumn("begin", F.col("inner") + F.col("before")))
    total = stream.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    whole, rest = divmod(total, window)
    ends = np.cumsum([1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]).tolist()
    ends = F.array(*(F.lit(whole * window + e) for e in ends)) if ends else F.array().cast("array<bigint>")

    def sequence(p):
        return F.when(p < whole * window, F.floor(p / window)).otherwise(F.lit(whole) + F.size(F.filter(ends, lambda e: e <= p)))

    def opens(s):
        return F.when(s <= whole, s * window).otherwise(F.try_element_at(ends, (s - whole).cast("int")))

    def closes(s):
        return F.when(s < whole, (s + 1) * window).otherwise(F.try_element_at(ends, (s - whole + 1).cast("int")))

    begin, stop = F.col("begin"), F.col("begin") + F.col("size")
    stream = stream.withColumn("s", F.explode(F.sequence(sequence(begin).cast("long"), sequence(stop - 1).cast("long"))))
    a, b = F.greatest(begin, opens(F.col("s"))), F.least(stop, closes(F.col("s")))
    stream = stream.withColumns({"sequence_id": F.lit(plan.windows) + F.col("s"), "offset": a - opens(F.col("s")), "from": F.col("from") + a - begin, "size": b - a})
    found = ["__key", "part", "row", "start", "length", "crc", "doc_tokens", "from", "size", "sequence_id", "offset"]
    all_pieces = (
        joined.withColumns({"size": F.col("head"), "sequence_id": F.col("window")}).select(*found)
        .union(stream.select(*found))
        .union(full.withColumns({"from": F.lit(0), "size": F.col("length"), "sequence_id": F.lit(plan.windows + whole + rest.bit_count()) + F.col("rank"), "offset": F.lit(0)}).select(*found))
    )
    columns = [F.col("__key").alias(key), (F.col("start") + F.col("from")).alias("start"), F.col("size").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")]
    kind = "<u2" if _words(path).small else "<u4"

    @F.pandas_udf("ids array<int>, crc long")
    def part_of(ids: pd.Series, first: pd.Series, size: pd.Series) -> pd.DataFrame:
        parts = [np.frombuffer(x, kind)[f : f + n].astype("<u4") for x, f, n in zip(ids, first, size, strict=True)]
        return pd.DataFrame({"ids": [p.astype(np.int32) for p in parts] if keep_ids else [None] * len(parts), "crc": [zlib.crc32(p) for p in parts]})

    def with_ids(some: DataFrame) -> DataFrame:
        return some.join(cut.select("part", "row", "ids"), ["part", "row"]).withColumn("p", part_of("ids", "from", "size")).withColumns({"crc": F.col("p.crc"), "ids": F.col("p.ids")})

    if keep_ids:
        return with_ids(all_pieces).select(*columns, "ids")
    intact = F.col("size") == F.col("length")
    return all_pieces.where(intact).select(*columns).union(with_ids(all_pieces.where(~intact)).select(*columns))
