"""Similarity digests: improbable byte windows in chained Bloom filters."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, table

#: Bytes of a window, and how far around it no less probable one may lie.
WINDOW, RADIUS = 64, 16
#: Entropy of a usual window of text, in bits a byte: what is far from it is improbable.
USUAL_BITS = 4.0
#: Positions that are ranked at a time, and bytes of texts that are taken together.
BLOCK, TOGETHER = 1 << 15, 1 << 19
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
_U = np.uint64
_BYTE = table(11, 256)
#: c * log2(c) for each count c of a byte in a window, in whole units of 2**-14 bits so that sums are exact.
_UNIT = 1 << 14
_CLOG = np.round(np.concatenate(([0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1)))) * _UNIT).astype(np.int64)
_STEP = np.concatenate(([0], np.diff(_CLOG)))


def ladder(raw: np.ndarray, top: int) -> dict[int, np.ndarray]:
    """Hashes of the 1, 2, 4, ... top bytes from each position, by doubling."""
    out = {1: _BYTE[raw]}
    size = 1
    while size < top:
        h = out[size]
        if len(h) <= size:
            h = np.zeros(0, _U)
        else:
            h = h[:-size] * _U(0xD6E8FEB86659FD93 + 2 * size) + h[size:]
            h ^= h >> _U(32)
        size *= 2
        out[size] = h
        if size > 32:
            out.pop(size // 2)
    return out


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n bytes (a power of two) from each position."""
    return ladder(raw, n)[n]


def entropies(raw: np.ndarray) -> np.ndarray:
    """Shannon entropy of the window at each position, in bits times WINDOW * _UNIT.

    One byte leaves and one comes from each window to the next: what that changes
    follows from how often the one stands in the window after it, and the other
    in the window before it.
    """
    ahead, behind = np.ones(len(raw), np.uint8), np.ones(len(raw), np.uint8)
    for shift in range(1, WINDOW):
        same = (raw[:-shift] == raw[shift:]).view(np.uint8)
        ahead[:-shift] += same
        behind[shift:] += same
    total = np.empty(len(raw) - WINDOW + 1, np.int64)
    total[0] = _CLOG[np.bincount(raw[:WINDOW])].sum()
    total[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[:-WINDOW]]
    return int(np.log2(WINDOW)) * WINDOW * _UNIT - np.cumsum(total)


def selected(raw: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Feature hashes at the local maxima of rarity, 0 where there is none.

    ``valid`` tells which windows of ``raw`` count; RADIUS positions at both ends are
    surroundings only.
    """
    n = len(valid) - 2 * RADIUS
    hashes = ladder(raw, WINDOW)
    rare = np.abs(entropies(raw) - int(USUAL_BITS * WINDOW * _UNIT)).astype(_U)
    # rarity first, then the hash of the place: no two windows nearby tie but equal ones, of which the first counts
    rank = np.where(valid, (rare + _U(1)) << _U(40) | mix(hashes[8][: len(valid)]) >> _U(24), _U(0))
    most = rank
    for shift in (1, 2, 4, 8):
        most = np.maximum(most[:-shift], most[shift:])
    mine = rank[RADIUS : RADIUS + n]
    best = (mine > most[:n]) & (mine >= most[RADIUS + 1 : RADIUS + 1 + n])
    return np.where(best, mix(hashes[WINDOW][RADIUS : RADIUS + n]) | _U(1 << 63), _U(0))


def features_of(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the selected windows of each text, in order of position.

    Every window is ranked.  A text shorter than a window is one feature; an empty one
    has none.
    """
    long = [t for t in texts if len(t) >= WINDOW]
    size = np.array([len(t) for t in long], np.int64)
    end = RADIUS + np.cumsum(size)
    raw = np.frombuffer(b"".join((b"\0" * RADIUS, *long, b"\0" * (RADIUS + WINDOW))), np.uint8)
    valid = np.zeros(len(raw), bool)
    for a, b in zip((end - size).tolist(), end.tolist(), strict=True):
        valid[a : b - WINDOW + 1] = True
    at, found, last = [], [], int(end[-1]) if long else 0
    for a in range(RADIUS, last, BLOCK):
        b = min(a + BLOCK, last)
        got = selected(raw[a - RADIUS : b + RADIUS + WINDOW - 1], valid[a - RADIUS : b + RADIUS])
        at.append(a + np.flatnonzero(got))
        found.append(got[got > 0])
    cuts = np.searchsorted(np.concatenate(at), end[:-1]) if long else []
    parts = iter(np.split(np.concatenate(found), cuts) if long else [])
    return [next(parts) if len(t) >= WINDOW else mix(np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little")], _U)) if t else np.zeros(0, _U) for t in texts]


def features(data: bytes) -> np.ndarray:
    return features_of([data])[0]


def filters(found: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, one row of bits for every FEATURES features in turn."""
    out = np.zeros((-(-len(found) // FEATURES), FILTER_BITS), np.uint8)
    row = np.arange(len(found)) // FEATURES
    for i in range(HASHES):
        out[row, (found >> _U(11 * i)).astype(np.int64) & (FILTER_BITS - 1)] = 1
    return out


def encode(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits, axis=None).tobytes()).decode() if len(bits) else ""


def decode(digest: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(base64.b64decode(digest), np.uint8))
    return bits.reshape(-1, FILTER_BITS)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best overlap beyond chance, on average.

    Two empty digests are alike (1); an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = a.sum(1, dtype=np.float64), b.sum(1, dtype=np.float64)
    best = np.zeros(len(a))
    right = b.T.astype(np.float32)
    for i in range(0, len(a), 256):
        both = a[i : i + 256].astype(np.float32) @ right
        chance = na[i : i + 256, None] * nb / FILTER_BITS
        least = np.minimum(na[i : i + 256, None], nb)
        best[i : i + 256] = np.clip((both - chance) / np.maximum(least - chance, 1e-9), 0, 1).max(1)
    return float(np.average(best, weights=na))


def fingerprints(texts: list[str | None]) -> list[np.ndarray]:
    return [filters(f) for f in features_of([(t or "").encode() for t in texts])]


def fingerprint(text: str | bytes | None) -> np.ndarray:
    data = text.encode() if isinstance(text, str) else text or b""
    return filters(features(data))


def groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """The rows in lists whose texts (the last value) have about TOGETHER characters at most, or of a single row."""
    out, size = [], 0
    for row in rows:
        n = len(row[-1] or "") + WINDOW
        if out and size + n > TOGETHER:
            yield out
            out, size = [], 0
        out.append(row)
        size += n
    if out:
        yield out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row of ``docs`` (doc_id, text); null text as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups((i.as_py(), t.as_py()) for batch in batches for i, t in zip(batch.column(0), batch.column(1), strict=True)):
            found = [encode(f) for f in fingerprints([t for _, t in group])]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in group], pa.int64()), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(task, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many from the next text's start."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


#: Characters of text in a range of ids, about, and ranges at most.
RANGE_CHARS, MOST_RANGES = 16 << 20, 4096


def spots(spark, n: int) -> list[int]:
    """For each of n partitions a number that ``repartition`` sends there: ranges dealt by their own numbers would share some partitions and leave others empty."""
    found = spark.range(0, 64 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).groupBy("to").agg(F.min("id")).collect()  # a row a partition
    at = dict(map(tuple, found))
    return [at.get(i, i) for i in range(n)]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_in_order(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and likeness to that and to the next row's.

    Rows stand in order of (doc_id, text), null ids first; after the last comes the
    first.  Rows are dealt out by ranges of ids; the first of each range also goes to the
    range before it, so that each text moves once and nothing is gathered.  Null text
    counts as empty; repeated rows each get a row and follow one another; a single row
    follows itself.
    """
    spark = docs.sparkSession
    low = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(low)))
    fine, chars = rows.agg(F.percentile_approx("key", [i / MOST_RANGES for i in range(1, MOST_RANGES)], 4 * MOST_RANGES), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n = min(MOST_RANGES, max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS))
    cuts = sorted({fine[i * MOST_RANGES // n - 1] for i in range(1, n)}) if fine else []
    bounds = F.lit(cuts).cast("array<long>") if cuts else F.array().cast("array<long>")
    size, steps = len(cuts), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]

    def jump(at, s):
        return F.when((at + s <= size) & (F.get(bounds, at + s - 1) <= F.col("key")), at + s).otherwise(at)

    rows = rows.withColumn("bucket", F.aggregate(F.lit(steps), F.lit(0), jump) if cuts else F.lit(0))
    firsts = dict(sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.min("key")).collect()))
    have = list(firsts)
    first = F.lit([firsts.get(i, 0) for i in range(size + 1)]).cast("array<long>")
    back = F.lit([have[have.index(i) - 1] if i in firsts else 0 for i in range(size + 1)])
    own = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("extra"))
    more = F.struct(F.get(back, F.col("bucket")).alias("to"), F.lit(True).alias("extra"))
    rows = rows.withColumn("dealt", F.explode(F.when(F.col("key") == F.get(first, F.col("bucket")), F.array(own, more)).otherwise(F.array(own))))
    rows = rows.select("dealt.to", "dealt.extra", "key", "doc_id", "text", F.get(F.lit(spots(spark, size + 1)).cast("array<long>"), F.col("dealt.to")).alias("spot")).repartition(size + 1, "spot").drop("spot").sortWithinPartitions("to", "extra", "key", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        dealt = (tuple(batch.column(i)[k].as_py() for i in (0, 1, 3, 4)) for batch in batches for k in range(batch.num_rows))
        for group in groups(dealt):
            due = []
            for (to, extra, doc_id, text), own in zip(group, fingerprints([r[-1] for r in group]), strict=True):
                if before and before[0] == to:
                    due.append((*before[1:], edited(before[2], text), own))
                # after the first of the next range nothing of this one follows
                before = None if extra else (to, doc_id, text, own)
            changed = iter(fingerprints([new for _, text, _, new, _ in due if new != text]))
            out = [result(*row, row[2] if row[3] == row[1] else next(changed)) for row in due]
            if out:
                yield record(out)

    def result(doc_id, text, own, new, next_own, print_):
        return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), encode(own), encode(print_), likeness(own, print_), likeness(own, next_own))

    def record(out):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(task, SCHEMA)
