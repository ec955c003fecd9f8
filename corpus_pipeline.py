"""A corpus pipeline of five stages; each works on what the one before kept.

``STAGES`` names them in order.  A stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.

All stages judge whole texts, keep rows that repeat unless they say otherwise, take an
empty table to an empty one, and leave out columns that ``documents`` doesn't have,
whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellspark.llm import decontaminate, langid, minhash, pieces, secrets
from cellspark.llm.queries import held_out
from cellspark.llm.store import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undecided: a null or empty text, no letters, or a narrow margin; a null id or lang stays.

    Texts of any length are judged alike: the margin is summed over slices of the whole text.
    """
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs.select(*COLUMNS), model).where("not rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies: 0.8 or more of their shingles in common.

    Null and blank texts are no copies and stay.  The verdict is on the text: ids that repeat
    or are null lose nothing but copies; rows that repeat as a whole are copies, and one stays.
    """
    return minhash.drop_near_duplicates(docs.select(*COLUMNS), (80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts hold none and stay."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in texts; no document is dropped, null texts stay null and have null n_chars.

    ``spark.cellspark.ledger`` may name a ledger that is kept between runs, so that known texts are not scanned again.
    """
    clean = secrets.redact(docs.select(*COLUMNS), ledger_path=spark.conf.get("spark.cellspark.ledger", None))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding them gives the text again; null ids and true for a null text."""
    return pieces.round_trip(docs.select(*COLUMNS)).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "round_trip")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("piece_encoding", piece_encoding)]

#: Compression, MinHash and tokenisation have no SQL form; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
