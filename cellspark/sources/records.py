"""The records of one large JSON file, read by many tasks.

Spark's text reader deals out byte ranges of the file; pieces end at closing braces, wherever these stand.  One pass finds what each
range does to the state of the text (in a string, how deep) for each state it may begin in; with the ranges' own beginnings known, a
second pass cuts the records out.  What lies across ranges is put together by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import written

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[\[{]|[\]}]', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.S)
_KEY = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*(.)', re.S)
#: Characters between two records that are looked at for the name of their array.
_GAP = 2000
#: States of a text: outside strings, in one, in one behind a backslash.
OUT, IN, BEHIND = 0, 1, 2


class Scan:
    """Follows a text, piece by piece, from a state and a depth of brackets."""

    def __init__(self, state: int = OUT, depth: int = 0):
        self.state, self.depth = state, depth

    def brackets(self, text: str) -> Iterator[tuple[int, bool]]:
        """(place, whether it opens) of each bracket outside strings; ``depth`` is that before it."""
        at = 0
        if self.state != OUT and text:
            at = 1 if self.state == BEHIND else 0
            m = _REST.match(text, at)
            self._string_ends(text, m)
            at = m.end() if self.state == OUT else len(text)
        for m in _TOKEN.finditer(text, at):
            first = text[m.start()]
            if first == '"':
                self._string_ends(text, m)
                if self.state != OUT:
                    return
            else:
                opens = first in "[{"
                yield m.start(), opens
                self.depth += 1 if opens else -1

    def _string_ends(self, text: str, m: re.Match) -> None:
        self.state = OUT if m[1] else BEHIND if m.end() < len(text) else IN


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.concat("value", F.lit("}")).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(section, pos, record): each object of the arrays at the top of the file, as JSON text, with the array's name and its place there.

    Other values at the top give nothing.  The driver gets a row for each byte range and for each array.
    """
    pieces = _pieces(spark, path)

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scans: dict[tuple[str, int], list[Scan]] = {}
        for batch in batches:
            for (file, block), part in batch.groupby(["file", "block"], sort=False):
                text = "".join(part["text"])
                for s in scans.setdefault((file, block), [Scan(x) for x in (OUT, IN, BEHIND)]):
                    for _ in s.brackets(text):
                        pass
        for (file, block), found in scans.items():
            yield pd.DataFrame([(file, block, i, s.state, s.depth) for i, s in enumerate(found)], columns=["file", "block", "before", "after", "deeper"])

    told = pieces.mapInPandas(effects, "file string, block long, before int, after int, deeper long").collect()
    effect = {(r["file"], r["block"], r["before"]): (r["after"], r["deeper"]) for r in told}
    begins: dict[tuple[str, int], tuple[int, int]] = {}
    last: dict[str, tuple[int, int]] = {}
    for file, block in sorted({(r["file"], r["block"]) for r in told}):
        begins[file, block] = state, depth = last.get(file, (OUT, 0))
        after, deeper = effect[file, block, state]
        last[file] = after, depth + deeper

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], list] = {}  # scan, whether in a record, records begun, fragments
        for batch in batches:
            out = []
            for (file, block), part in batch.groupby(["file", "block"], sort=False):
                if (file, block) not in held:
                    scan = Scan(*begins[file, block])
                    held[file, block] = [scan, begins[file, block][1] > 2, 0, 0]
                now, text, start = held[file, block], "".join(part["text"]), 0
                scan = now[0]

                def give(end: int, closes: bool, text=text, now=now, file=file, block=block) -> None:
                    part = text[start:end]  # noqa: B023
                    if now[1] or re.search(r'[":\[]', part):
                        out.append((file, block, now[3], now[2], now[1], closes, part if now[1] else part[-_GAP:]))  # noqa: B023
                        now[3] += 1

                for at, opens in scan.brackets(text):
                    if opens and scan.depth == 2 and text[at] == "{":
                        give(at, True)
                        now[1], now[2], start = True, now[2] + 1, at
                    elif not opens and scan.depth == 3 and now[1]:
                        give(at + 1, True)
                        now[1], start = False, at + 1
                give(len(text), False)
            yield pd.DataFrame(out, columns=["file", "block", "turn", "begun", "inside", "closes", "text"])

    found = written(pieces.mapInPandas(cut, "file string, block long, turn long, begun long, inside boolean, closes boolean, text string"))
    counts = {(r["file"], r["block"]): r["n"] for r in found.groupBy("file", "block").agg(F.max("begun").alias("n")).collect()}
    earlier, so_far = [], {}
    for file, block in sorted(begins):
        earlier.append((file, block, so_far.get(file, 0)))
        so_far[file] = so_far.get(file, 0) + counts.get((file, block), 0)
    ranges = spark.createDataFrame(earlier, "file string, block long, earlier long") if earlier else spark.createDataFrame([], "file string, block long, earlier long")
    placed = found.join(ranges, ["file", "block"]).withColumn("number", F.col("earlier") + F.col("begun"))
    in_turn = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "turn", "text"))), lambda x: x["text"]), "")
    whole = placed.groupBy("file", "inside", "number").agg(in_turn.alias("text"))
    arrays = []
    for r in sorted(whole.where("not inside").collect(), key=lambda r: (r["file"], r["number"])):  # a row an array, and what else stands between records
        keys = _KEY.findall(r["text"])
        if keys:
            name = keys[-1][0] if keys[-1][1] == "[" and r["text"].rstrip().endswith("[") else None
            arrays.append((r["file"], r["number"], name))
    table = F.array(*(F.struct(F.lit(f).alias("file"), F.lit(n).cast("long").alias("number"), F.lit(k).cast("string").alias("name")) for f, n, k in arrays)) if arrays else None
    rows = whole.where("inside")
    if table is None:
        return rows.where("false").select(F.lit("").alias("section"), F.col("number").alias("pos"), F.col("text").alias("record"))
    mine = F.element_at(F.filter(table, lambda x: (x["file"] == F.col("file")) & (x["number"] < F.col("number"))), -1)
    return rows.withColumn("a", mine).where("a.name is not null").select(F.col("a.name").alias("section"), (F.col("number") - F.col("a.number") - 1).alias("pos"), F.col("text").alias("record"))
