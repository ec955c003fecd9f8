"""Quality grades by ordinal regression: one weight vector, ordered thresholds.

P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...: a cumulative-link model.  x are
hashed words and coarse shape features of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import BY_LETTER, blocks, hash_spans, lower, mix, table, words

DIMS = 1 << 17
#: The model is fitted on about so many labelled documents, chosen by a hash of the text.
SAMPLE = 6000
STEPS, RATE, RIDGE = 300, 0.1, 2e-2
#: Power of the inverse share of a grade that its documents weigh.
BALANCE = 0.5
#: Features of fewer training documents say more of those documents than of grades.
LEAST_DOCS = 5
#: Grades: toxic, poor, good.
GRADES = 3
#: Kept: documents whose probability of a grade above poor is at least this.
KEEP = 0.5
_U = np.uint64
_SHAPE = table(31, 64).reshape(8, 8)


def shapes(raw: np.ndarray, off: np.ndarray, count: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Eight binned features of each row: repetition, case, signs, digits, length."""
    size = np.maximum(np.diff(off), 1)

    def share(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return (total[off[1:]] - total[off[:-1]]) / size

    upper = share((raw >= 65) & (raw <= 90))
    digit = share((raw >= 48) & (raw <= 57))
    sign = share((raw < 128) & ~np.isin(raw, np.frombuffer(b" \n\t.,", np.uint8)) & ~((raw >= 48) & (raw <= 57)) & ~((raw >= 65) & (raw <= 90)) & ~((raw >= 97) & (raw <= 122)))
    line = share(raw == 10)
    space = share(raw == 32)
    repeat = 1 - distinct / np.maximum(count, 1)
    mean = np.diff(off) / np.maximum(count, 1)
    edges = ((repeat, (0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9)), (upper, (0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)), (digit, (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6)), (sign, (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)), (line, (0.001, 0.003, 0.01, 0.02, 0.05, 0.1, 0.2)), (space, (0.02, 0.05, 0.1, 0.14, 0.17, 0.2, 0.3)), (count, (5, 10, 20, 50, 100, 500, 2000)), (mean, (3, 4, 5, 6, 7, 9, 12)))
    return np.stack([_SHAPE[i][np.searchsorted(e, v)] for i, (v, e) in enumerate(edges)], 1)


def features(raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each row: words and shapes."""
    low = lower(raw)
    starts, ends, rows = words(low, off, BY_LETTER)
    hashes = hash_spans(low, starts, ends, seed=32)
    count = np.diff(rows)
    alone = [np.unique(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    shape = shapes(raw, off, count, np.array([len(x) for x in alone]))
    # five copies of a shape feature under hashes of their own: they weigh more against many words
    out = []
    for i, x in enumerate(alone):
        out.append(np.unique(np.concatenate((x, mix(shape[i, :, None] + np.arange(5, dtype=_U)).ravel())) & _U(DIMS - 1)).astype(np.int32))
    return out


def only(rows: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """Known features of each row; a row without any stands on feature 0."""
    none = np.zeros(1, np.int32)
    return [x if len(x := r[known[r]]) else none for r in rows]


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, known: np.ndarray):
        self.weights, self.thresholds, self.known = weights, thresholds, known

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        """P(grade > k) of each row, one column a threshold."""
        if not rows:
            return np.zeros((0, len(self.thresholds)))
        rows = only(rows, self.known)
        at = np.concatenate(rows)
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        n = np.array([len(r) for r in rows], np.float64)
        score = np.add.reduceat(self.weights[at], first) / n**0.25
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def ordered(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first and the logarithms of the gaps."""
    return free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, n_grades: int = GRADES) -> Model:
    """Full-batch Adam on the mean log likelihood with a ridge; thresholds stay ordered by construction."""
    weights, free = np.zeros(DIMS), np.array([-2.0] + [0.5] * (n_grades - 2))
    if not len(rows):
        return Model(weights, ordered(free), weights > 0)
    known = np.bincount(np.concatenate(rows), minlength=DIMS) >= LEAST_DOCS
    rows = only(rows, known)
    at = np.concatenate(rows)
    size = np.array([len(r) for r in rows])
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    scale = size**-0.25
    spread = np.repeat(scale, size)
    seen = np.bincount(grades, minlength=n_grades)
    share = (len(grades) / (np.maximum(seen, 1) * max(1, (seen > 0).sum()))) ** BALANCE
    each = share[grades] / share[grades].sum()
    m, v, fm, fv = np.zeros(DIMS), np.zeros(DIMS), np.zeros(len(free)), np.zeros(len(free))
    for step in range(1, steps + 1):
        cuts = ordered(free)
        score = np.add.reduceat(weights[at], first) * scale
        up = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -30, 30)))
        full = np.column_stack((np.ones(len(rows)), up, np.zeros(len(rows))))
        p = np.maximum(full[np.arange(len(rows)), grades] - full[np.arange(len(rows)), grades + 1], 1e-9)
        slope = np.column_stack((np.zeros(len(rows)), up * (1 - up), np.zeros(len(rows))))
        above, below = slope[np.arange(len(rows)), grades], slope[np.arange(len(rows)), grades + 1]
        d_score = -each * (above - below) / p
        grad = np.bincount(at, np.repeat(d_score, size) * spread, DIMS) + RIDGE * weights / len(rows) ** 0.5
        d_cut = np.array([(each * np.where(grades == k + 1, slope[:, k + 1] / p, np.where(grades == k, -slope[:, k + 1] / p, 0))).sum() for k in range(len(cuts))])
        later = np.cumsum(d_cut[::-1])[::-1]
        d_free = np.concatenate((later[:1], later[1:] * np.exp(free[1:])))
        for x, g, a, b in ((weights, grad, m, v), (free, d_free, fm, fv)):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x -= RATE * (1 - step / (steps + 1)) * (1 if x is weights else 4) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(weights, ordered(free), known)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good; the worst of several labels."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents, or on about ``sample`` of them.

    The sample is the documents whose hash lies under a share: bounded, and the same on
    every run.  Their features, not their texts, come to the driver.
    """
    marks = graded(labels)
    n = max(1, marks.count())
    picked = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) / float(2**31) < sample / n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked.hint("broadcast") if sample <= 100_000 else picked, "doc_id").select("grade", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, raw, off in blocks(batch.column(1)):
                found = features(raw, off)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(top, len(found)), pa.array([x.tobytes() for x in found], pa.binary())], ["grade", "at"])

    got = sorted((bytes(r["at"]), r["grade"]) for r in rows.mapInArrow(task, "grade int, at binary").toLocalIterator())
    return fit([np.frombuffer(b, np.int32) for b, _ in got], np.array([g for _, g in got], np.int64))


SCHEMA = "doc_id long, expected_grade double, p_above_toxic double, p_good double, grade int, keep boolean"


def grade(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): expected grade, tail probabilities, most likely grade, keep.

    Null and empty texts are graded by their shape features alone.  No shuffle.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, raw, off in blocks(batch.column(1)):
                up = sent.value.tails(features(raw, off))
                p = np.column_stack((1 - up[:, 0], up[:, 0] - up[:, 1], up[:, 1]))
                columns = (up.sum(1), up[:, 0], up[:, 1], p.argmax(1).astype(np.int32), up[:, 1] >= keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(top, len(up)), *map(pa.array, columns)], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(task, SCHEMA)
