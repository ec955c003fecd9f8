"""Benchmark decontamination with suffix arrays over the training text.

Each task builds a suffix array over the words of its shard of documents and
binary-searches every distinct suffix of the benchmark items in it.  A suffix array entry
that cannot match (its first three words start no test window) is left out before
sorting, so the sort touches a small part of the corpus.  Documents never shuffle.

The benchmark is a query set taken in blocks of at most ``BLOCK_CHARS`` characters.  One block
at a time is made on the driver, broadcast, searched in all documents, and
dropped, so driver and tasks hold one block however large the benchmark is; each further
block costs one more scan of the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stash
from .words import BY_LETTER, blocks, hash_spans, lower, mix, words

WINDOW = 10
LEAD = 3
#: Characters of benchmark text in one broadcast, which bound its words.
BLOCK_CHARS = 4_000_000
_U = np.uint64


class Suffixes:
    """The distinct suffixes of a block of benchmark items, ready for binary search.

    An item of at least ``window`` words gives one suffix for each window start;
    a shorter one gives its whole sequence.  Items of equal text stand in the block once.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        names: dict[str, list[str | None]] = {}
        for name, text in items:
            names.setdefault(text or "", []).append(name)
        #: names of each distinct text, sorted, and the least for reports (nameless last)
        self.names = [sorted({str(x) for x in n if x is not None}) for n in names.values()]
        self.label = [(not n, n[0] if n else "") for n in self.names]
        texts = [t.encode() for t in names]
        raw = lower(np.frombuffer(b"".join(texts), np.uint8))
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        starts, ends, rows = words(raw, off, BY_LETTER)
        self.hashes = hash_spans(raw, starts, ends)
        self.start, self.stop = rows[:-1], rows[1:]
        n = np.diff(rows)
        self.longest = int(n.max(initial=0))
        self.runs = levels(self.hashes, self.longest)
        count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
        item = np.repeat(np.arange(len(n)), count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + self.start[item]
        size = np.minimum(window, n)[item]
        self.sizes = [int(k) for k in np.unique(size)]
        #: for each window size: a place of each distinct window, all places grouped by window, and where the groups begin
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        #: and hashes of the leading words, with a bit table of them
        self.leads, self.bits = {}, {}
        for k in self.sizes:
            here = at[size == k]
            order = np.lexsort(tuple(self.hashes[here + i] for i in range(k - 1, -1, -1)))
            here = here[order]
            new = np.concatenate(([True], np.any([self.hashes[here[1:] + i] != self.hashes[here[:-1] + i] for i in range(k)], axis=0)))
            first = np.flatnonzero(new)
            self.windows[k] = here[first], here, np.append(first, len(here))
            self.leads[k] = np.unique(lead(self.hashes, here[first], min(k, LEAD)))
            self.bits[k] = np.zeros(1 << 20, bool)
            self.bits[k][(self.leads[k] >> _U(44)).astype(np.int64)] = True


def lead(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), _U)
    for i in range(n):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[at + i]
    return mix(out)


def suffix_array(hashes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` sorted by the ``depth`` words that follow, word hashes standing for words."""
    return at[np.lexsort(tuple(hashes[at + i] for i in range(depth - 1, -1, -1)))]


def search(hashes: np.ndarray, sa: np.ndarray, test: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of ``sa`` whose first ``depth`` words equal its own.

    One vectorised binary search a word: the range narrows word by word.
    """
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(sa), np.int64)
    for i in range(depth):
        column, want = hashes[sa + i], test[at + i]
        low, high = _bound(column, want, low, high, False), _bound(column, want, low, high, True)
    return low, high


def _bound(column: np.ndarray, want: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        value = column[np.minimum(mid, len(column) - 1)]
        right = open_ & ((value <= want) if after else (value < want))
        low = np.where(right, mid + 1, low)
        high = np.where(open_ & ~right, mid, high)


def match_block(raw: np.ndarray, off: np.ndarray, test: Suffixes, detail: bool = True) -> tuple[np.ndarray, np.ndarray, list[set[str]], list[tuple | None]]:
    """Words of each row, marks of hit words, and with ``detail`` each row's items and longest match.

    A longest match is (-length, is nameless, item or "", place in the row, place in the
    item); of several the least, places in words.  Each place of a row starts one window at
    most, so the work follows the places found, not their product with the items'.
    """
    n = len(off) - 1
    raw = lower(raw)
    starts, ends, rows = words(raw, off, BY_LETTER)
    hashes = hash_spans(raw, starts, ends)
    count = np.diff(rows)
    items: list[set[str]] = [set() for _ in range(n)]
    longest: list[tuple | None] = [None] * n
    marks = np.zeros(len(hashes) + 1, np.int64)
    row_end = np.repeat(rows[1:], count)
    runs: list[np.ndarray] = []
    for size in test.sizes:
        at = np.flatnonzero(np.arange(len(hashes)) + size <= row_end) if len(hashes) else np.zeros(0, np.int64)
        if not len(at):
            continue
        first = lead(hashes, at, min(size, LEAD))
        near = test.bits[size][(first >> _U(44)).astype(np.int64)]
        at, first = at[near], first[near]
        have = test.leads[size]
        at = at[have[np.minimum(np.searchsorted(have, first), len(have) - 1)] == first]
        if not len(at):
            continue
        sa = suffix_array(hashes, at, size)
        one, places, begins = test.windows[size]
        low, high = search(hashes, sa, test.hashes, one, size)
        for w in np.flatnonzero(low < high):
            found, there = sa[low[w] : high[w]], places[begins[w] : begins[w + 1]]
            marks[found] += 1
            marks[found + size] -= 1
            if detail:
                who = np.searchsorted(rows, found, "right") - 1
                which = np.searchsorted(test.start, there, "right") - 1
                names = set().union(*(test.names[i] for i in set(which.tolist())))
                for r in set(who.tolist()):
                    items[r] |= names
                runs = runs or levels(hashes, test.longest)
                lengthen(runs, rows, found, who, test, there, which, size, longest)
    return count, np.cumsum(marks[:-1]) > 0, items, longest


def levels(hashes: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4 ... words from each place on, as far as runs of ``most`` words need; past the end they say nothing."""
    out = [hashes]
    while 2 << (len(out) - 1) <= most and len(hashes):
        step = 1 << (len(out) - 1)
        last = out[-1]
        out.append(mix(last * _U(0xD6E8FEB86659FD93) + last[np.minimum(np.arange(len(last)) + step, len(last) - 1)]))
    return out


def lengthen(runs, rows, found, who, test, there, which, size, longest) -> None:
    """Carries the matches of one window on to the right, and the best of each row to ``longest``.

    A match that also goes on to the left is left out where that is cheap to tell: the longer one that starts
    before it is seen at its own window.  So places are dealt by the word before them, unless many such words are on both sides.
    """
    hashes = runs[0]
    before_p = np.where(found > rows[who], hashes[found - 1], _U(0))
    before_q = np.where(there > test.start[which], test.hashes[there - 1], _U(1))
    if len(before_p) == len(before_q) == 1 and before_p[0] == before_q[0]:
        return
    both = np.intersect1d(before_p, before_q)
    # places in the items in the order in which equal lengths are reported
    order = np.array(sorted(range(len(there)), key=lambda i: (*test.label[which[i]], int(there[i] - test.start[which[i]]))), np.int64)
    if len(both) > 32:
        carry(runs, rows, found, who, test, there[order], which[order], size, longest)
        return
    rest = ~np.isin(before_p, both)
    carry(runs, rows, found[rest], who[rest], test, there[order], which[order], size, longest)
    for word in both:
        mine, others = before_p == word, order[before_q[order] != word]
        carry(runs, rows, found[mine], who[mine], test, there[others], which[others], size, longest)


def carry(runs, rows, found, who, test, there, which, size, longest) -> None:
    """The longest match of each place ``found`` of the rows with any of the places ``there`` of the items, which come in order of report.

    All places go on together, by falling powers of two words: those of the row and those of the items that have these
    words in common form a group, and a place goes on where its group has one of an item.  Places that
    can't reach their row's best any more are left out.
    """
    if not len(found) or not len(there):
        return
    room = int((test.stop[which] - there).max())
    worth = np.array([longest[r] is None or min(int(rows[r + 1]) - p, room) >= -longest[r][0] for p, r in zip(found.tolist(), who.tolist(), strict=True)])
    found, who = found[worth], who[worth]
    stop_p, stop_q = rows[who + 1], test.stop[which]
    group_p, depth_p = np.zeros(len(found), np.int64), np.full(len(found), size, np.int64)
    q, group_q, depth_q = np.arange(len(there)), np.zeros(len(there), np.int64), np.full(len(there), size, np.int64)
    groups = 1
    for k in range(min(len(runs), len(test.runs)) - 1, -1, -1):
        at_p, at_q = np.flatnonzero(found + depth_p + (1 << k) <= stop_p), np.flatnonzero(there[q] + depth_q + (1 << k) <= stop_q[q])
        if not len(at_p) or not len(at_q):
            continue
        key = mix(np.concatenate((runs[k][(found + depth_p)[at_p]], test.runs[k][(there[q] + depth_q)[at_q]])) + mix(np.concatenate((group_p[at_p], group_q[at_q])).astype(_U)))
        number = np.unique(key, return_inverse=True)[1]
        of_p, of_q = number[: len(at_p)], number[len(at_p) :]
        both = np.intersect1d(of_p, of_q)
        go_p, go_q = np.isin(of_p, both), np.isin(of_q, both)
        group_p[at_p[go_p]], depth_p[at_p[go_p]] = groups + of_p[go_p], depth_p[at_p[go_p]] + (1 << k)
        new = at_q[go_q]
        stay = np.isin(group_q, group_p)  # a place of an item also stays with those of the row that don't go on
        q, group_q, depth_q = np.concatenate((q[stay], q[new])), np.concatenate((group_q[stay], groups + of_q[go_q])), np.concatenate((depth_q[stay], depth_q[new] + (1 << k)))
        groups += int(number.max()) + 1
    best = np.full(groups, len(there), np.int64)
    np.minimum.at(best, group_q, q)
    for i, depth, first in zip(range(len(found)), depth_p.tolist(), best[group_p].tolist(), strict=True):
        r, k = int(who[i]), int(which[first])
        if longest[r] is None or depth >= -longest[r][0]:
            now = (-depth, *test.label[k], int(found[i]) - int(rows[r]), int(there[first]) - int(test.start[k]))
            longest[r] = now if longest[r] is None else min(longest[r], now)


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, longest_words long, longest_item string, longest_at long, longest_item_at long"


PART = "blob binary, runs array<struct<start:long,stop:long>>, items array<string>, best struct<size:long,nameless:boolean,item:string,at:long,item_at:long>"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: words, words hit by a benchmark window, and the items.

    Null or empty text has no words.  Items with equal texts are all reported;
    repeated items count once by id.  An empty benchmark, or items without words,
    hit nothing.  A document word is hit if it lies inside an occurrence of any
    ``window`` consecutive item words, or of a whole item that is shorter.
    An item whose id is null hits like any other but has no name: it is not among
    ``items`` and not counted in ``n_items``.  ``longest_at`` and ``longest_item_at`` are
    the places, in words from 0, where the longest match begins in the document and in
    its item.  Repeated document rows each get a row.  A benchmark of several blocks is
    searched block by block; what each finds is written and then joined by the
    text's content.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found, several = [], False
    for test, last in lasts(benchmark_blocks(benchmark, block_chars)):
        if last and not several:
            return whole_matches(docs, Suffixes(test, window))
        several = True
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes(test, window))
        found.append(stash(block_matches(docs, sent).dropDuplicates(["blob"])))
        sent.destroy()
    return joined_matches(docs, found)


def lasts(parts: Iterator) -> Iterator[tuple]:
    """Each part, and whether it is the last; an empty one if there is none."""
    now = next(parts, [])
    for after in parts:
        yield now, False
        now = after
    yield now, True


def hit_counts(hit: np.ndarray, count: np.ndarray) -> np.ndarray:
    edge = np.concatenate(([0], np.cumsum(count)))
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[edge[1:]] - total[edge[:-1]]


def whole_matches(docs: DataFrame, test: Suffixes) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(test)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, off in blocks(batch.column(1)):
                n, marks, items, longest = match_block(raw, off, sent.value)
                hit = hit_counts(marks, n)
                names = [sorted(x) for x in items]
                sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(sha), pa.array(hit > 0), pa.array(names, pa.list_(pa.string())), pa.array([-x[0] if x else 0 for x in longest], pa.int64()), pa.array([None if not x or x[1] else x[2] for x in longest], pa.string()), *(pa.array([x[k] if x else None for x in longest], pa.int64()) for k in (3, 4))],
                    [f.split()[0] for f in SCHEMA.split(", ")],
                )

    return docs.mapInArrow(task, SCHEMA)


def block_matches(docs: DataFrame, sent) -> DataFrame:
    """What one block of the benchmark finds: a row for each row of ``docs`` that it hits, by content."""
    rows = docs.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for first, raw, off in blocks(batch.column(1)):
                n, marks, items, longest = match_block(raw, off, sent.value)
                edge = np.concatenate(([0], np.cumsum(n)))
                for r in np.flatnonzero(hit_counts(marks, n)):
                    m = np.diff(marks[edge[r] : edge[r + 1]].astype(np.int8), prepend=0, append=0)
                    runs = [{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(m == 1), np.flatnonzero(m == -1), strict=True)]
                    x = longest[r]
                    out.append((batch.column(0)[first + int(r)].as_py(), runs, sorted(items[r]), dict(zip(("size", "nameless", "item", "at", "item_at"), x, strict=True))))
            run, best = pa.struct([("start", pa.int64()), ("stop", pa.int64())]), pa.struct([("size", pa.int64()), ("nameless", pa.bool_()), ("item", pa.string()), ("at", pa.int64()), ("item_at", pa.int64())])
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.list_(run), pa.list_(pa.string()), best), strict=True)], ["blob", "runs", "items", "best"])

    return rows.mapInArrow(task, PART)


def joined_matches(docs: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The blocks' findings put together: at most one row a block for each text."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = stash(every.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("best").alias("best")))
    # runs in order of their start: what reaches beyond all before adds to the count
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(s["end"], x["start"]))).alias("n"))
    n_hit = F.coalesce(F.aggregate("runs", start, step, lambda s: s["n"]), F.lit(0).cast("long"))
    n_words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", n_words.alias("n_words"), F.unhex(F.sha2("text", 256)).alias("blob")).join(every, "blob", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"),
        F.coalesce(-F.col("best.size"), F.lit(0)).cast("long").alias("longest_words"), F.when(~F.col("best.nameless"), F.col("best.item")).alias("longest_item"), F.col("best.at").alias("longest_at"), F.col("best.item_at").alias("longest_item_at"),
    )


def benchmark_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most ``block_chars`` characters (a longer item stands alone); one partition of them comes to the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null").distinct().toLocalIterator():
        n = len(row[1]) + 1
        if block and size + n > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns stay.

    Works in the scan, without a join: the check runs on each row's own text.  With a
    benchmark of several blocks, what each leaves is written for the next.
    """
    place, schema = docs.columns.index("text"), docs.schema

    def without(rows: DataFrame, sent) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [np.zeros(0, bool)]
                for _, raw, off in blocks(batch.column(place)):
                    n, marks, _, _ = match_block(raw, off, sent.value, detail=False)
                    keep.append(hit_counts(marks, n) == 0)
                yield batch.filter(pa.array(np.concatenate(keep)))

        return rows.mapInArrow(task, schema)

    rows, before = docs, []
    for items, last in lasts(benchmark_blocks(benchmark, block_chars)):
        sent = docs.sparkSession.sparkContext.broadcast(Suffixes(items))
        if last:
            return without(rows, sent)
        rows = stash(without(rows, sent))
        sent.destroy()
        discard(*before)
        before = [rows]
    return rows
