"""Ranked lexical search: postings in a table bucketed by term, integer scores, top documents by a window."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .store import discard, shared_dir, stash

#: Terms: digits, letters of ASCII and everything beyond it; only A-Z are lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: Bytes of text that one block of postings is made from (a longer document stands alone).
BLOCK_BYTES = 1 << 24
#: A term's postings are dealt over so many bucket keys.
SALTS = 16
#: Terms of items that are broadcast at once; more items are asked in further blocks.
ASKED = 500_000
#: Bits of a document's place: row in its block, block in its partition.
_ROW_BITS, _BLOCK_BITS = 20, 22

_POSTINGS = "term string, block long, docs array<int>, counts array<int>, ids array<long>"


@dataclass
class Index:
    """``name`` is a table of (term, salt, block, docs, counts, ids), bucketed and sorted by term.

    A row has the documents of one block that hold the term and how often; the row of
    a block whose term is null has the number of terms of every document, and its id.
    """

    spark: SparkSession
    name: str
    path: str

    def postings(self) -> DataFrame:
        return self.spark.table(self.name).where("term is not null").drop("ids")

    def documents(self) -> DataFrame:
        """(place, doc_id, n) of every document, those without terms too."""
        each = self.spark.table(self.name).where("term is null").select("block", F.explode(F.arrays_zip("docs", "counts", "ids")).alias("d"))
        return each.select(_place(F.col("d.docs")).alias("place"), F.col("d.ids").alias("doc_id"), F.col("d.counts").cast("long").alias("n"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        at = self.spark.read.schema("term string").parquet(self.path)
        at.stashed = self.path
        discard(at)


def _place(doc):
    return F.shiftleft(F.col("block"), _ROW_BITS) + doc


def block_postings(ids: pa.Array, raw: np.ndarray, off: np.ndarray, block: int) -> pa.RecordBatch:
    """The postings of one block of texts, given as bytes and offsets."""
    low = words.lower(raw)
    starts, ends, first = words.words(low, off, words.BY_LETTER)
    n = np.diff(first)
    # words side by side, without what is between them
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(low[words.BY_LETTER[low]]))).dictionary_encode()
    rows = len(n)
    pair, count = np.unique(terms.indices.to_numpy().astype(np.int64) * max(1, rows) + np.repeat(np.arange(rows), n), return_counts=True)
    term, doc = np.divmod(pair, max(1, rows))
    cut = np.searchsorted(term, np.arange(len(terms.dictionary) + 1))
    lists = np.concatenate((cut, [cut[-1] + rows])).astype(np.int32)  # the last row: all documents
    whole = lambda a, b: pa.ListArray.from_arrays(pa.array(lists), pa.array(np.concatenate((a, b)).astype(np.int32)))
    names = pa.concat_arrays([terms.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    none = np.zeros(len(names) + 1, np.int32)
    none[-1] = rows
    id_lists = pa.ListArray.from_arrays(pa.array(none), ids.cast(pa.int64()))
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), block)), whole(doc, np.arange(rows)), whole(count, n), id_lists], ["term", "block", "docs", "counts", "ids"])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Postings of every document, whole texts.

    Null and empty texts have no terms.  Ids may be null or repeat: a document is a row.  Further columns are ignored.
    """
    spark = docs.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _BLOCK_BITS
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << _ROW_BITS):
                part = batch.slice(at, 1 << _ROW_BITS)
                for row, raw, off in words.blocks(part.column(1), BLOCK_BYTES):
                    yield block_postings(part.column(0).slice(row, len(off) - 1), raw, off, block)
                    block += 1

    made = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(task, _POSTINGS)
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"postings_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    salted = made.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int"))
    salted.repartition(buckets, "term", "salt").write.bucketBy(buckets, "term", "salt").sortBy("term").option("path", path).format("parquet").saveAsTable(name)
    return Index(spark, name, path)


def terms(text: str):
    """The terms of a text column, repeats included; none for null."""
    return F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(PATTERN), F.lit(0))


def search(index: Index, items: DataFrame, key: str = "item_id", text: str = "text", top: int = TOP) -> DataFrame:
    """(key, rank, doc_id, score): the ``top`` documents of highest score above 0 for each item.

    Equal scores stand by ascending doc_id (null first), then in the order of the index, so that ranks are unique.
    Items without terms, or with none that any document holds, have no rows; each row is an item of its
    own, if ids repeat too.  A term counts as often as the item has it.
    """
    spark = index.spark
    # numbered before terms are exploded: beside explode, each term would get a number
    each = items.select(F.monotonically_increasing_id().alias("item"), F.col(key), terms(text).alias("terms"))
    asked = stash(each.select("item", key, F.explode("terms").alias("term")).groupBy("item", key, "term").agg(F.count("*").alias("times")))
    n_docs, n_terms = index.documents().where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = asked.select("term").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = index.postings().join(wanted, ["term", "salt"]).groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weighted = stash(held.select("term", F.monotonically_increasing_id().alias("number"), weight.cast("long").alias("weight")))
    # matches are dealt by document, where scores are summed for all items
    salted = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    matched = index.postings().join(salted, ["term", "salt"]).select("number", "weight", "block", F.explode(F.arrays_zip("docs", "counts")).alias("d"))
    length = F.expr(f"25 + cast(75 * n as decimal(19,0)) * cast({n_docs} as decimal(19,0)) div {max(1, n_terms)}")
    sized = index.documents().where("n > 0").select("place", "doc_id", length.alias("m"))
    tf = F.col("d.counts").cast("long").alias("tf")
    hits = matched.select("number", "weight", _place(F.col("d.docs")).alias("place"), tf).join(sized.hint("shuffle_hash"), "place")
    score = F.expr("weight * ((1000000000 * tf) div (1000 * tf + 8 * m))")
    hits = hits.select("place", "doc_id", "number", score.alias("score"))
    questions = asked.join(weighted.select("term", "number"), "term").select("item", key, "number", "times")
    blocks = -(-asked.count() // ASKED)
    if blocks > 1:
        hits = stash(hits).repartition("place")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "place")
    found = []
    for k in range(max(1, blocks)):
        some = questions.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else questions
        sums = hits.join(F.broadcast(some), "number").groupBy("place", "doc_id", "item", key).agg(F.sum(F.col("score") * F.col("times")).alias("score"))
        best = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found.append(stash(best.select(key, "rank", "doc_id", "score")))
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    discard(asked, weighted)
    return out
