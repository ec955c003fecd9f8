"""SentencePiece encoding and decoding over a relational lattice.

A word's lattice has an edge for each of its substrings that is a piece.  Spark explodes
the bounded-length substrings of the corpus' frequent words, joins them to the piece
table, groups the edges by word and folds over them with ``aggregate``.  The outcome, a
lexicon of bounded size, goes to the tasks that encode texts; words outside it take the
same lattice and the same fold there, so the lexicon's size changes the speed only.

The fold follows the model.  For a unigram model it is Viterbi: the best-scoring path.  For
a BPE model scores are ranks of merges, not log probabilities, and the best-scoring path is
not what the model encodes; there the fold merges neighbours, best edge first.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words of the lexicon at most; longer words than this are left to the tasks.
LEXICON, LEXICON_CHARS = 30_000, 48
#: Characters that no piece covers cost this much more than the worst piece.
UNKNOWN = 10.0
#: Words and parts of words that a task remembers at most.
WORDS, PARTS = 250_000, 250_000


class Table:
    """The pieces of a model: ids, scores, and what they stand for."""

    def __init__(self, path: str = MODEL):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.text: list[str | int | None] = [None] * n
        self.bytes = [model.unk_id()] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = int(piece[3:5], 16)
            elif not model.is_control(i) and not model.is_unknown(i) and not model.is_unused(i):
                self.ids[piece], self.scores[piece], self.text[i] = i, model.get_score(i), piece
        self.ranks = {p: -s for p, s in self.scores.items()}
        self.longest = max(map(len, self.ids))
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Scores of a BPE model are 0, -1, -2, ...
        self.merges = all(s == round(s) for s in self.scores.values())
        self.worst = min(self.scores.values()) - UNKNOWN

    def rows(self) -> list[tuple[str, int, float]]:
        return [(p, i, self.scores[p]) for p, i in self.ids.items()]


def marked(text: str) -> str:
    """The text as the model sees it: a leading space, and marks for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def best_path(word: str, table: Table) -> tuple[int, ...]:
    """Viterbi over the word's lattice: starts in order, then ends; the first best stays."""
    n = len(word)
    score, back = [0.0] + [-np.inf] * n, [(0, ())] * (n + 1)
    ids, scores = table.ids, table.scores
    for s in range(n):
        here = score[s]
        for e in range(s + 1, min(n, s + table.longest) + 1):
            piece = word[s:e]
            i = ids.get(piece)
            if i is not None:
                new, path = here + scores[piece], (i,)
            elif e == s + 1:
                new, path = here + table.worst, tuple(table.bytes[b] for b in piece.encode())
            else:
                continue
            if new > score[e]:
                score[e], back[e] = new, (s, path)
    out: list[tuple[int, ...]] = []
    e = n
    while e:
        e, path = back[e]
        out.append(path)
    return tuple(i for path in reversed(out) for i in path)


def best_merges(word: str, table: Table) -> tuple[int, ...]:
    """Merge neighbours into pieces, best score first, the leftmost of equals."""
    rank, none = table.ranks.get, 1 << 60
    if len(word) > 200:
        parts = long_merges(word, table)
    else:
        parts = list(word)
        waits = [rank(x + y, none) for x, y in zip(parts, parts[1:])]  # noqa: B905
        while waits and (best := min(waits)) < none:
            i = waits.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del waits[i]
            if i:
                waits[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(waits):
                waits[i] = rank(parts[i] + parts[i + 1], none)
    ids = table.ids
    out: list[int] = []
    for piece in parts:
        i = ids.get(piece)
        out += (i,) if i is not None else (table.bytes[b] for b in piece.encode())
    return tuple(out)


def long_merges(word: str, table: Table) -> list[str]:
    """The same with a heap: n log n for a word of n characters."""
    n, ranks = len(word), table.ranks
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # symbols by their starts
    heap: list[tuple[float, int, int, int]] = []

    def offer(s):
        middle = after[s] if s >= 0 else n
        if middle < n and after[middle] - s <= table.longest and (rank := ranks.get(word[s : after[middle]])) is not None:
            heapq.heappush(heap, (rank, s, middle, after[middle]))

    for s in range(n):
        offer(s)
    alive = [True] * n
    while heap:
        _, s, middle, e = heapq.heappop(heap)
        if not alive[s] or after[s] != middle or after[middle] != e:
            continue
        alive[middle], after[s] = False, e
        if e < n:
            before[e] = s
        offer(s)
        offer(before[s])
    return [word[s : after[s]] for s in range(n) if alive[s]]


def path(word: str, table: Table) -> tuple[int, ...]:
    return best_merges(word, table) if table.merges else best_path(word, table)


def frequent_words(texts: DataFrame, most: int = LEXICON) -> DataFrame:
    """(word) of the most frequent words of (text), at most ``most``: those of at least some count."""
    bare = texts.where("length(text) > 0").select(F.explode(F.split(F.translate("text", SPACE, " "), " ")).alias("bare"))
    counts = bare.where(F.length("bare").between(1, LEXICON_CHARS - 1)).groupBy("bare").count()
    counts = counts.select(F.concat(F.lit(SPACE), "bare").alias("word"), "count")
    # counts of counts: a few thousand rows however large the corpus
    level = F.when(F.col("count") < 1000, F.col("count")).otherwise(1000 * F.floor(F.log2(F.col("count"))))
    counts = stash(counts.withColumn("level", level).where("level > 1"))
    total, least = 0, 10**9
    for row in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    return counts.where(F.col("level") >= least).select("word")


EDGE = "array<struct<s:int,e:int,score:double,ids:array<int>>>"
STATE = "array<struct<score:double,ids:array<int>>>"


def lattice(words: DataFrame, spark: SparkSession, table: Table) -> DataFrame:
    """(word, edges): substrings of at most the longest piece's length, joined to the pieces."""
    pieces = F.broadcast(spark.createDataFrame(table.rows(), "piece string, id int, score double"))  # a model's table: its size is fixed
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda s: F.transform(F.sequence(s + 1, F.least(F.length("word"), s + table.longest)), lambda e: F.struct(s.alias("s"), e.alias("e"))))))
    cut = words.select("word", spans.alias("x")).select("word", "x.s", "x.e", F.substring(F.col("word"), F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("piece"))
    found = cut.join(pieces, "piece", "left").where("id is not null or e = s + 1")
    octets = F.hex(F.encode("piece", "UTF-8"))
    byte_ids = F.lit(table.bytes).cast("array<int>")
    raw = F.transform(F.sequence(F.lit(1), F.length(octets), F.lit(2)), lambda i: F.get(byte_ids, F.conv(F.substring(octets, i, F.lit(2)), 16, 10).cast("int")))
    edges = found.select("word", F.struct("s", "e", F.coalesce("score", F.lit(table.worst)).alias("score"), F.when(F.col("id").isNull(), raw).otherwise(F.array("id")).cast("array<int>").alias("ids")).alias("edge"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the fold is the work here, so its few rows stay spread
    return edges.repartition(parts, "word").groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))


def viterbi(grouped: DataFrame) -> DataFrame:
    """(word, ids) of the best-scoring path: starts in order, then ends; the first best stays."""
    none = F.struct(F.lit(None).cast("double").alias("score"), F.array().cast("array<int>").alias("ids"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))), F.array_repeat(none, F.length("word"))).cast(STATE)

    def step(state, x):
        here = F.get(state, x["s"])
        new = here["score"] + x["score"]
        old = F.get(state, x["e"])["score"]
        better = F.struct(new.alias("score"), F.concat(here["ids"], x["ids"]).alias("ids"))
        put = F.transform(state, lambda cell, i: F.when(i == x["e"], better).otherwise(cell))
        return F.when(old.isNull() | (new > old), put).otherwise(state)

    return grouped.select("word", F.aggregate("edges", start, step, lambda state: F.get(state, F.length("word"))["ids"]).alias("ids"))


def merged(grouped: DataFrame) -> DataFrame:
    """(word, ids) by merging neighbours.

    The state is the cuts between symbols, at first around each character.  An edge applies
    if it spans just two symbols; the best such edge removes the cut inside it.
    """
    ranked = grouped.withColumn("ranked", F.array_sort(F.transform(F.filter("edges", lambda x: x["e"] > x["s"] + 1), lambda x: F.struct((-x["score"]).alias("r"), x["s"].alias("s"), x["e"].alias("e")))))

    def step(cuts, _):
        at = lambda p: F.array_position(cuts, p)
        best = F.get(F.filter("ranked", lambda x: (at(x["s"]) > 0) & (at(x["e"]) == at(x["s"]) + 2)), 0)
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c: (c <= best["s"]) | (c >= best["e"])))

    n = F.length("word")
    start = F.sequence(F.lit(0), n)
    cuts = F.aggregate(F.sequence(F.lit(1), n), start, step)
    whole = ranked.select("word", "edges", cuts.alias("cuts"))
    ids = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.get(F.filter("edges", lambda x: (x["s"] == F.get("cuts", i)) & (x["e"] == F.get("cuts", i + 1))), 0)["ids"])
    return whole.select("word", F.flatten(ids).alias("ids"))


def lexicon(texts: DataFrame, table: Table, most: int = LEXICON) -> dict[str, bytes]:
    """The frequent words of (text), without their mark, and their ids as int32; at most ``most`` rows come to the driver."""
    spark = texts.sparkSession
    edges = lattice(frequent_words(texts, most), spark, table)
    return {r[0][1:]: np.array(r[1], np.int32).tobytes() for r in (merged if table.merges else viterbi)(edges).toLocalIterator()}


def cuts(word: str, pairs: set[str]) -> list[str]:
    """The word cut between characters that stand side by side in no piece.

    No edge of the lattice spans such a place, so the parts' encodings are the word's.
    """
    at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
    return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]


class Parts(dict):
    """Ids of parts of words as int32, computed when first asked for."""

    def __init__(self, table: Table):
        self.table = table

    def __missing__(self, part: str) -> bytes:
        ids = np.array(path(part, self.table), np.int32).tobytes()
        if len(self) < PARTS and len(part) <= LEXICON_CHARS:
            self[part] = ids
        return ids


class Words(dict):
    """Ids of words after one space as int32: the lexicon's, others by their parts."""

    def __init__(self, known: dict[str, bytes], table: Table):
        super().__init__(known)
        self.parts, self.most, self.table = Parts(table), len(known) + WORDS, table

    def __missing__(self, bare: str) -> bytes:
        ids = self.marked(SPACE + bare)
        if len(self) < self.most and len(bare) <= LEXICON_CHARS:
            self[bare] = ids
        return ids

    def marked(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, cuts(word, self.table.pairs)))


class Encoder:
    """Encodes and decodes texts with a lexicon, and a bounded memory of other words."""

    def __init__(self, table: Table, known: dict[str, bytes]):
        self.table, self.words = table, Words(known, table)
        #: what a piece stands for; a byte beyond ASCII needs its neighbours
        self.plain = [x if isinstance(x, str) else chr(x) if isinstance(x, int) and x < 128 else "" for x in table.text]
        self.high = np.array([isinstance(x, int) and x >= 128 for x in table.text])

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        bare = text.replace(SPACE, " ").split(" ")
        if "" not in bare:
            return np.frombuffer(b"".join(map(self.words.__getitem__, bare)), np.int32)
        out, spaces = [], ""  # marks before a word beyond its own
        for word in bare:
            if not word:
                spaces += SPACE
                continue
            out.append(self.words.marked(spaces + SPACE + word) if spaces else self.words[word])
            spaces = ""
        if spaces:
            out.append(self.words.marked(spaces))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.plain))]
        if self.high[ids].any():
            return self.decode_bytes(ids.tolist())
        return self.unmarked("".join(map(self.plain.__getitem__, ids.tolist())))

    def decode_bytes(self, ids: list[int]) -> str:
        """The same for texts with characters in pieces of single bytes."""
        out, raw = [], bytearray()
        for i in ids:
            piece = self.table.text[i]
            if isinstance(piece, int):
                raw.append(piece)
            elif piece:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
                out.append(piece)
        out.append(raw.decode("utf-8", "replace"))
        return self.unmarked("".join(out))

    @staticmethod
    def unmarked(text: str) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _with(df: DataFrame, task, **new: T.DataType) -> DataFrame:
    schema = T.StructType(list(df.schema.fields))
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return df.mapInArrow(task, schema)


def _coded(docs: DataFrame, model: str, most: int, finish, **new: T.DataType) -> DataFrame:
    """``docs`` through tasks that encode its text and hand each slice, its texts and ids to ``finish``."""
    table = Table(model)
    known = lexicon(docs.select(F.col("text").cast("string").alias("text")), table, most)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(table, known))  # a process's tasks share what it remembers
    place = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = batch.slice(i, 500)
                texts = rows.column(place).to_pylist()
                ids = [None if t is None else encoder.encode(t) for t in texts]
                more = [pa.array(ids, pa.list_(pa.int32())), pa.array([0 if x is None else len(x) for x in ids], pa.int64()), *finish(encoder, texts, ids)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*batch.schema.names, *new])

    return _with(docs, task, **new)


def encode(docs: DataFrame, model: str = MODEL, most: int = LEXICON) -> DataFrame:
    """``docs`` with ids (array of int) and n_tokens of its text.

    Null text gives null ids and 0 tokens, empty text none.  Characters without a piece
    become the ids of their UTF-8 bytes.  A text that holds the space mark itself is
    encoded as if it held a space there, which decoding can't tell.  Columns ids and n_tokens of
    ``docs`` are replaced; all rows stay, repeated ones too.
    """
    docs = docs.drop("ids", "n_tokens")
    return _coded(docs, model, most, lambda encoder, texts, ids: [], ids=T.ArrayType(T.IntegerType()), n_tokens=T.LongType())


def round_trip(docs: DataFrame, model: str = MODEL, most: int = LEXICON) -> DataFrame:
    """``encode``, and round_trip: whether decoding the ids gives the text again (null: true).

    The task that encodes a text decodes it too, so that texts pass to Python once.
    """
    docs = docs.drop("ids", "n_tokens", "round_trip")

    def same(encoder, texts, ids):
        return [pa.array([t is None or encoder.decode(x) == t for t, x in zip(texts, ids, strict=True)], pa.bool_())]

    return _coded(docs, model, most, same, ids=T.ArrayType(T.IntegerType()), n_tokens=T.LongType(), round_trip=T.BooleanType())


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` with decoded, the text of its ids; null ids give null, unknown ids nothing."""
    rows = rows.drop("decoded")
    table = rows.sparkSession.sparkContext.broadcast(Table(model))
    place = rows.columns.index("ids")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(table.value, {})
        for batch in batches:
            text = [encoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "decoded"])

    return _with(rows, task, decoded=T.StringType())
