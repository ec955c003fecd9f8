"""Removal of repeated byte strings, by prefix doubling over ranks of positions.

A string of ``LENGTH`` bytes is repeated if it also starts earlier.  Prefix doubling
ranks positions by ever longer prefixes and goes on only with those whose rank is not
unique yet.  Here a rank is a 64-bit fingerprint, made in the task that holds the text by
combining the ranks of two half prefixes; Spark brings equal ranks together.

Ranking every position would move a row for each byte, so each window of ``LENGTH`` bytes
is represented by the place in it whose ``GRAM``-byte rank is least.  Equal windows have
the same place, so no repeat is lost.  Neighbouring windows share theirs; they form a run.
Then

1. rank the runs by the ``GRAM`` bytes at their place: a unique rank is done;
2. rank the runs by all their bytes: all but the first run of a rank are repeated;
3. where one place still has several ranks, split the first run of each into short runs of
   ``SHORT`` windows and do the same with the bytes that all windows of a short run share;
4. and at last with single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fingerprints import grams, ladder
from .store import discard, stash
from .words import blocks, mix

LENGTH = 100
GRAM = 24
SHORT = 8
#: Rank bits that give way to the position when the least rank in a window is sought.
_PLACE = 26
_U = np.uint64


def rank24(steps: dict[int, np.ndarray]) -> np.ndarray:
    n = len(steps[8]) - 16
    return mix(steps[16][:n] * _U(0x9FB21C651E98DF25) + steps[8][16:])


def runs(raw: np.ndarray, off: np.ndarray, steps: dict[int, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, start, length, rank of the place, place - start) of each run in the block.

    start is counted from the block's first byte.
    """
    n = len(raw) - LENGTH + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, _U), none
    rank = rank24(steps)
    place = max(_PLACE, int(len(raw)).bit_length())
    key = rank & ~_U(2**place - 1) | np.arange(len(rank), dtype=_U)
    span, size = LENGTH - GRAM + 1, 1
    while 2 * size <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    at = (key & _U(2**place - 1)).astype(np.int64)
    lens = np.diff(off)
    whole = np.flatnonzero(lens >= LENGTH)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, off[whole], 1)
    np.add.at(inside, off[whole + 1] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    first[off[whole]] = True
    start = np.flatnonzero(first)
    row = np.searchsorted(off, start, "right") - 1
    stop = np.minimum(np.append(start[1:], n), off[row + 1] - LENGTH + 1)
    return row, start, stop - start, rank[at[start]], at[start] - start


def run_ranks(h: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Ranks of the bytes that a run's windows cover, from three of the ranks ``h`` of 64 bytes."""
    size = length + LENGTH - 1
    out = h[start] * _U(0x9FB21C651E98DF25) + h[start + (size - 64) // 2]
    out = (out ^ (out >> _U(31))) * _U(0xD6E8FEB86659FD93) + h[start + size - 64]
    return mix(mix(out) + (length * 128 + place).astype(_U))


def short_runs(raw: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rank of the shared bytes, rank of all bytes, start, length, place - start) of the short runs of each run.

    Short runs are counted from the place, so that equal windows fall into equal ones.
    """
    high, low = place // SHORT, (place - length + 1) // SHORT
    n = high - low + 1
    step = np.repeat(high, n) - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    at = np.repeat(start + place, n)
    first = np.maximum(np.repeat(start, n), at - SHORT * step - SHORT + 1)
    last = np.minimum(np.repeat(start + length, n) - 1, at - SHORT * step)
    h = grams(raw, 64)
    core = at - SHORT * step
    shared = mix(h[core] * _U(0x9FB21C651E98DF25) + h[core + LENGTH - SHORT + 1 - 64] + step.astype(_U))
    size = last - first + 1
    return shared, run_ranks(h, first, size, at - first), first, size, at - first


def single_runs(raw: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for the single windows of each run."""
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
    h = grams(raw, 64)
    a, b = h[at], h[at + LENGTH - 64]
    one = np.ones(len(at), np.int64)
    return mix(a * _U(0x9FB21C651E98DF25) + b), mix(b * _U(0xA24BAED4963EE407) + (a ^ (a >> _U(29)))), at, one, 0 * one


def pack(start: np.ndarray, length: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (start << 14) + (length << 7) + place


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(_U).view(np.int64) if x.dtype == _U else x.astype(np.int64), pa.int64())


def place_ranks(rows: DataFrame) -> DataFrame:
    """How often each place's rank occurs, added up within a block of text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in blocks(batch.column(1)):
                rank, n = np.unique(runs(raw, off, ladder(raw, 16))[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(rank), pa.array(n, pa.int32())], ["rank", "n"])

    return rows.mapInArrow(task, "rank long, n int")


def all_runs(rows: DataFrame) -> DataFrame:
    """(rank of the place, rank of the run, key, start with length and place in one number)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for top, raw, off in blocks(batch.column(1)):
                steps = ladder(raw, 64)
                row, start, length, rank, place = runs(raw, off, steps)
                if len(row):
                    yield pa.RecordBatch.from_arrays([_long(rank), _long(run_ranks(steps[64], start, length, place)), _long(ids[top + row]), _long(pack(start - off[row], length, place))], ["rank", "run", "key", "at"])

    return rows.mapInArrow(task, "rank long, run long, key long, at long")


def split_runs(texts: DataFrame, how) -> DataFrame:
    """The shorter runs that ``how`` makes of the runs ``at`` of each (key, text, at)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, at in zip(*batch.columns, strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                packed = np.unique(at.values.to_numpy(zero_copy_only=False))
                packed = packed[(packed >> 14) + (packed >> 7 & 127) - 1 + LENGTH <= len(raw)]
                if len(packed):
                    rank, run, start, length, place = how(raw, packed >> 14, packed >> 7 & 127, packed & 127)
                    yield pa.RecordBatch.from_arrays([_long(rank), _long(run), pa.array([key.as_py()] * len(rank), pa.int64()), _long(pack(start, length, place))], ["rank", "run", "key", "at"])

    return texts.select("key", F.col("text").cast("binary").alias("text"), "at").mapInArrow(task, "rank long, run long, key long, at long")


def firsts(runs_: DataFrame) -> DataFrame:
    return runs_.groupBy("rank", "run").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("n"))


def repeats(runs_: DataFrame, first: DataFrame) -> DataFrame:
    again = runs_.join(first.where("n > 1").select("rank", "run", "first"), ["rank", "run"])
    # equal places (rows of one id) are not earlier than one another
    return again.where(F.struct("key", F.shiftright("at", 14)) > F.struct("first.key", F.shiftright("first.at", 14))).select("key", "at")


def settle(runs_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repeated runs, runs to split) of the stashed (rank, run, key, at), which is discarded.

    Of equal runs all but the first are repeated.  The first of each is to be split if
    other runs share its rank.
    """
    first = stash(firsts(runs_))
    again = stash(repeats(runs_, first))
    several = first.groupBy("rank").agg(F.count("*").alias("k")).where("k > 1").select("rank")
    split = stash(first.join(several, "rank", "left_semi").select("first.key", "first.at").groupBy("key").agg(F.collect_set("at").alias("at")))
    discard(runs_, first)
    return again, split


def repeated_runs(rows: DataFrame) -> DataFrame:
    """Runs of repeated windows in ``rows`` (key, text): (key, at) with start, length and place packed in at."""
    often = place_ranks(rows).groupBy("rank").agg(F.sum("n").alias("n")).where("n > 1").select("rank")
    again, parts = settle(stash(all_runs(rows).join(often.hint("shuffle_hash"), "rank", "left_semi")))
    more, shorter = settle(stash(split_runs(rows.join(parts.hint("shuffle_hash"), "key"), short_runs)))
    single = stash(split_runs(rows.join(shorter.hint("shuffle_hash"), "key"), single_runs))
    late = stash(repeats(single, firsts(single)))
    discard(single, parts, shorter)
    return again.union(more).union(late)


def first_bytes(rows: DataFrame, size: int) -> DataFrame:
    """(key, pos, rank) of each position of (key, text) with ``size`` bytes from there on: these bytes as a number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for top, raw, off in blocks(batch.column(1)):
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    n = max(0, b - a - size + 1)
                    rank = sum((raw[a + k : a + k + n].astype(np.int64) << 8 * (size - 1 - k) for k in range(size)), np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, keys[top + i], np.int64)), pa.array(np.arange(n)), pa.array(rank)], ["key", "pos", "rank"])

    return rows.mapInArrow(task, "key long, pos long, rank long")


def repeated_by_sorting(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, pos) where a string of ``length`` bytes starts that also starts earlier, by plain prefix doubling.

    Spark sorts the pairs of ranks at a position and at an offset from it, and their order
    is the new rank; the offset doubles until the ranks are unique or cover ``length``
    bytes.  Every position is a row in every round, so what is shuffled is many times the
    text: this is for small tables, and for the tests of ``dedup_substrings``.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = 4
    ranks = stash(first_bytes(rows, size))
    while size < length:
        step = min(size, length - size)
        pairs = stash(ranks.join(ranks.select("key", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next")), ["key", "pos"]))
        order = pairs.groupBy("rank", "next").count().orderBy("rank", "next").select("rank", "next", "count", F.monotonically_increasing_id().alias("now"))
        order = stash(order)
        discard(ranks)
        ranks = stash(pairs.join(order, ["rank", "next"]).select("key", "pos", F.col("now").alias("rank")))
        size += step
        if not order.where("count > 1").limit(1).count():
            break
    first = ranks.groupBy("rank").agg(F.min(F.struct("key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return ranks.join(first, "rank").where(F.struct("key", "pos") > F.struct("first.key", "first.pos")).select("key", "pos").distinct()


def cut(raw: bytes, packed: np.ndarray) -> tuple[int, int, list[tuple[int, int]]]:
    """Bytes removed, number of removed runs, and the (start, end) that stay."""
    if not len(packed):
        return 0, 0, [(0, len(raw))]
    packed = np.sort(packed)
    start, end = packed >> 14, (packed >> 14) + (packed >> 7 & 127) - 1 + LENGTH
    end = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    a, b = start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]
    edges = np.concatenate(([0], np.stack((a, b), 1).ravel(), [len(raw)])).reshape(-1, 2)
    return int((b - a).sum()), len(a), [(int(x), int(y)) for x, y in edges if x < y]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup_substrings(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): what stays of its UTF-8 bytes.

    A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a
    document of smaller id, or before in the same document (null ids count as the
    smallest).  Strings are judged on the input and never cross documents.  Null and
    short texts lose nothing.  Rows of the same id count as the same place, so repeated
    rows do not empty one another.  ``kept`` (bytes, as a cut may split a character) only
    with ``keep_bytes``.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    flagged = repeated_runs(rows).groupBy("key").agg(F.collect_set("at").alias("at"))
    whole = rows.join(flagged.hint("shuffle_hash"), "key", "left").select("key", F.col("text").cast("binary").alias("text"), "at")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, at in zip(*batch.columns, strict=True):
                raw = text.as_py()
                packed = np.array(at.values.to_numpy(zero_copy_only=False), np.int64) if at.is_valid else np.zeros(0, np.int64)
                packed = packed[(packed >> 14) + (packed >> 7 & 127) - 1 + LENGTH <= len(raw)]
                removed, spans, stay = cut(raw, packed)
                kept = b"".join(raw[a:b] for a, b in stay)
                key = key.as_py()
                out.append((None if key == -(2**63) else key, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return whole.mapInArrow(task, SCHEMA)
