"""Language identification by compression with one zstandard dictionary a language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The model is fitted on a sample of about so many documents a language,
SAMPLE_DOCS = 400
#: of which so many bytes become the dictionary.
DICT_BYTES = 1 << 17
#: Bytes of a slice of a text that is too long for its share of a dictionary.
PIECE = 128
LEVEL = 3
#: Longer texts are compressed in equal slices of so many bytes at most, each with the whole dictionary: it helps only at the start of a stream.
SLICE = 1 << 12
#: Texts whose second best size is less than this share above the best are rejected.
NARROW = 0.015
#: The languages of most distinct texts are learned, so many at most.
LANGUAGES = 256
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """Lower-case words with one space between: case, digits and signs say little of a language."""
    return _OTHER.sub(" ", text.lower()).encode()


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of ``rows`` (text, lang).

    Null or empty text and null lang teach nothing.  The sample is bounded and
    depends on the rows alone; about ``sample_docs`` texts a language, of a sixteenth of a
    dictionary each at most, come to the driver.  A text counts if its hash lies under the share that
    ``sample_docs`` are of the distinct texts of its language, so that copies neither
    shrink a dictionary nor fill it.  ``languages`` bounds what comes to the driver where many values of lang
    are rubbish: those of most distinct texts are learned, of equal ones the first by name.
    """
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and length(text) > 0")
    hashed = F.xxhash64("text")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count_distinct(hashed).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return {}
    part = F.pmod(hashed, F.lit(2**31)) / float(2**31)
    want = F.lit(False)
    for lang, n in sorted(counts.items()):
        want = want | ((F.col("lang") == lang) & (part < sample_docs / n))
    # no text gives more than it may fill of a dictionary
    picked = rows.where(want).select("lang", _sliced(F.col("text"), dict_bytes // 16).alias("text")).distinct().collect()
    found = {lang: dictionary([letters(r.text) for r in picked if r.lang == lang], dict_bytes) for lang in sorted(counts)}
    return {lang: d for lang, d in found.items() if d}


def _sliced(text: Column, most: int) -> Column:
    """The text, or 16 slices from all over it where it has more than ``most`` characters."""
    size = most // 16
    at = [(F.floor((F.length(text) - size) * i / 15) + 1).cast("int") for i in range(16)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *(F.substring(text, x, F.lit(size)) for x in at)))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """At most ``size`` bytes: short texts whole, and slices from all over the longer ones, a like share of each."""
    texts = sorted((t for t in texts if t.strip()), key=lambda t: (len(t), t))
    out, left = [], size
    for i, text in enumerate(texts):
        share = min(len(text), max(0, left // (len(texts) - i) - 1))
        out.append(_spread(text, share))
        left -= share + 1
    return b" ".join(out)


def _spread(text: bytes, size: int) -> bytes:
    """``size`` bytes in pieces of about ``PIECE`` bytes from all over the text."""
    if len(text) <= size:
        return text
    n = max(1, size // PIECE)
    piece = size // n
    return b"".join(text[x : x + piece] for x in ((len(text) - piece) * (2 * i + 1) // (2 * n) for i in range(n)))


class Classifier:
    """Compressed sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.langs = sorted(dictionaries)
        self.machines = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.machines.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """(language, score, rejected, margin in bytes)."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, True, 0
        data = letters(text)
        n = max(1, -(-len(data) // SLICE))
        parts = [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]
        sizes = [sum(len(m.compress(p)) for p in parts) for m in self.machines]
        best = int(np.argmin(sizes))
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] + 8)
        margin = second - sizes[best]
        return self.langs[best], 1.0 - 0.5 ** (margin / 2), len(sizes) > 1 and margin < NARROW * sizes[best], margin


SCHEMA = "lang_pred string, score double, rejected boolean, margin long"


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """``docs`` (any columns, text among them) with lang_pred, score, rejected and margin.

    Reads nothing but the text, and all of it.  ``und`` with score 0, rejected: null or
    empty text, text without letters, or no dictionaries.  Rejected too: a margin
    under ``NARROW`` of the best size, ties between languages included (the first in
    order of name is given); where there is one language only, nothing is narrow.  Sizes are sums over
    slices of ``SLICE`` bytes, so that a margin says the same of long texts as of short ones.  Columns of these names in ``docs`` are replaced.
    """
    new = ["lang_pred", "score", "rejected", "margin"]
    docs = docs.drop(*new)
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(place)]
            columns = list(zip(*got, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.float64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*batch.schema.names, *new])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"), ("margin", "long")):
        schema = schema.add(name, kind)
    return docs.mapInArrow(task, schema)
