import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellspark.llm import packing


def library(texts):
    from tokenizers import Tokenizer

    machine = Tokenizer.from_file(packing.tokenizer_path())
    return [e.ids for e in machine.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    r = random.Random(8)
    marks = ["a", "J", "I", "İ", "ß", "Σ", "é", "é", "J̌", "İ", "!", "...", "'s", "'LL", "don't", "A.", "b,́", "x.—", "9", "½", " ", "\n", " ", " ", "́", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>.", "中文", "ЖЁ.", "×.", "҃.", "🙂", "a̸=", "≠", "\x0b", "\x85", "﻿", "Ω", "K", "ǰ"]
    texts = ["".join(r.choice(marks) + r.choice(["", "", " "]) for _ in range(r.randrange(1, 30))) for _ in range(800)]
    return [None, "", "   ", "The End. The end, THE END!", "can't won't I'M", *texts]


@pytest.mark.parametrize("most", [packing.CACHE, 50])
def test_ids_equal_the_library(monkeypatch, most):
    monkeypatch.setattr(packing, "CACHE", most)
    machine = packing.Words(packing.tokenizer_path())
    texts = odd_texts()
    for part in (texts[:100], texts[100:], [], texts[:3], [None]):
        ids, off = machine.encode(pa.array(part, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library(part)


def test_least_squares_meets_its_conditions():
    r = np.random.default_rng(4)
    columns = packing.combinations(24)
    assert all(sum(c) == 24 and 1 not in c[2:] for c in columns.tolist()) and len({tuple(c) for c in columns.tolist()}) == len(columns)
    a = np.zeros((24, len(columns)))
    for j, c in enumerate(columns):
        for b in c[c > 0]:
            a[b, j] += 1
    for _ in range(5):
        h = r.integers(0, 50, 24).astype(float)
        x = packing.non_negative_least_squares(columns, h)
        h[0] = 0
        gain = a.T @ (h - a @ x)
        assert (x >= 0).all() and gain.max() < 1e-6 and np.abs(gain[x > 0]).max(initial=0) < 1e-6  # Kuhn and Tucker
    exact = np.zeros(24)
    exact[[16, 8, 12]] = 7, 7, 10
    assert sorted(packing.repeats(exact.astype(int))) == [((12, 12), 5), ((16, 8), 7)]


def check(rows, docs, window):
    """Every id of every document in one piece, sequences without gaps, all full or a power of two; pieces by document."""
    want = sorted((str(k), [*ids, 2]) for (k, _), ids in zip(docs, library([t for _, t in docs]), strict=True))
    pieces = {}
    for r in rows:
        pieces.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    total = sum(len(ids) for _, ids in want)
    assert sum(r.length for r in rows) == total
    spans = {}
    for r in rows:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    assert set(spans) == set(range(len(spans))) and all(n <= window and n & (n - 1) == 0 for n in sizes) and sum(n == window for n in sizes) == total // window
    for key, ids in want:
        got = pieces[key, len(ids)]
        for r in got:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and (zlib.crc32(part.tobytes()) == r.ids_crc32 or [k for k, _ in want].count(key) > 1)
    return pieces


@pytest.mark.parametrize("window,units", [(64, 16), (4096, 256)])
def test_packing_against_the_library(spark, window, units):
    r = random.Random(window)
    words = "the of and river stone light quiet water überall Straße ciónñ".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 20, 60, 200])))) for i in range(400)] + [(500 + i, "same words here " * 8) for i in range(200)]
    docs += [(900, None), (901, ""), (902, " ".join(words) * 3000), (None, "null id")]
    table = spark.createDataFrame([(i, t, 1, "x", 0) for i, t in docs], "doc_id long, text string, part int, ids string, `from` int").repartition(6)  # clashing names
    light = packing.pack(table, window=window, units=units, keep_ids=False).collect()
    pieces = check(light, docs, window)
    assert all(sorted((p.start, p.length) for p in v)[0][0] == 0 for v in pieces.values())
    heavy = packing.pack(table, window=window, units=units).collect()
    assert all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length for x in heavy) and len(heavy) == len(light)
    assert check(heavy, docs, window)


def test_packing_of_few_or_no_rows(spark):
    kind = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], kind), keep_ids=False).count() == 0
    rows = packing.pack(spark.createDataFrame([(7, "a b"), (7, "a b"), (8, None)], kind)).collect()
    assert sorted((x.doc_id, x.doc_tokens) for x in rows if x.start == 0) == [(7, 3), (7, 3), (8, 1)] and sum(x.length for x in rows) == 7
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], kind), window=100, units=10)
