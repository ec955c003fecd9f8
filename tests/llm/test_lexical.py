import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellspark.llm import lexical, words

FEW = {c: c + 32 for c in range(65, 91)}


def term_list(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FEW))


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score), sorted, by one loop over items and documents."""
    held = [(i, Counter(term_list(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            scores.append((-sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(term_list(text)).items() if t in c), i is not None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:top])]
    return sorted(out, key=str)


def got(found):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=str)


def texts():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éclair", "éclair", "A1", "straße", "СЛОВО", "слово", "İx", "中文"]
    prose = lambda n: r.choice([" ", "-", "_", ", "]).join(r.choice(vocabulary[: r.choice([5, 68])]) for _ in range(n))
    docs = [(i, prose(r.choice([1, 3, 30, 200]))) for i in range(150)]
    docs += [(200 + i, docs[7][1]) for i in range(25)] + [(7, docs[7][1]), (None, docs[7][1]), (301, None), (302, ""), (303, " .,\n"), (304, prose(20000)), (305, "w1" * 3000), (306, "X" * 70000 + " w3")]
    items = [(i, prose(12)) for i in range(12)] + [(20, None), (21, ""), (22, "nowhere to be"), (3, "w1 w1 w1 W1 w2"), (None, docs[7][1]), (24, "éclair Éclair İx straße")]
    return docs, items


@pytest.mark.parametrize("asked,salts", [(lexical.ASKED, 16), (40, 1)])
def test_search_against_brute_force(spark, monkeypatch, asked, salts):
    monkeypatch.setattr(lexical, "ASKED", asked)  # 40: several blocks of items
    monkeypatch.setattr(lexical, "SALTS", salts)
    docs, items = texts()
    table = spark.createDataFrame([(i, t, 5, "b") for i, t in docs], "doc_id long, text string, score int, block string").repartition(5)  # clashing names
    asks = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, term string")
    index = lexical.build(table)
    assert got(lexical.search(index, asks)) == plain(docs, items)
    assert got(lexical.search(index, asks, top=3)) == plain(docs, items, 3)
    assert index.documents().count() == len(docs) and index.postings().where("term = 'w3'").count() > 1
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items, rows in ((some.where("false"), asks, 0), (some.where("text is null"), asks, 0), (some, asks.where("false"), 0), (some, asks, 1)):
        found = lexical.search(lexical.build(docs), items)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == rows


def test_blocks_hold_every_posting():
    docs, _ = texts()
    column = pa.array([t for _, t in docs])
    raw, off = words.flat(column)
    block = lexical.block_postings(pa.array([i for i, _ in docs]), raw, off, 9).to_pylist()
    want = {(t, d): n for d, (_, x) in enumerate(docs) for t, n in Counter(term_list(x)).items()}
    assert {(b["term"], d): n for b in block if b["term"] is not None for d, n in zip(b["docs"], b["counts"], strict=True)} == want
    lengths = block[-1]
    assert lengths["counts"] == [len(term_list(t)) for _, t in docs] and lengths["ids"] == [i for i, _ in docs] and {b["block"] for b in block} == {9}
    none = lexical.block_postings(pa.array([], pa.int64()), np.zeros(0, np.uint8), np.zeros(1, np.int64), 0)
    assert none.num_rows == 1
