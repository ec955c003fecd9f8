"""Secret scans with an incremental blob ledger, in DataFrame functions only.

A blob is the content of a text, named by its SHA-256.  The ledger holds, for each
blob and rule version that has been scanned, what was found.  A scan hashes every
version of every document, drops the (blob, rule version) pairs that the ledger has,
runs the patterns over one copy of each blob that is left, and joins the findings
back to every document that ever held the blob.

The ledger is a Parquet table at a path that the caller names and keeps, written to by
appending.  Its key is the blob and the rule version, and the version follows from the
rules, so changed rules scan all anew and unchanged ones scan nothing twice.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import exists, shared_dir

#: A key's body: up to its END line; where that is missing, to the end of the base64 lines (line ends may be written as \n).
#: No group in it is tried again once it has matched, so that the time follows the length and no stack grows.
_TO_END = r"(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
_GAP, _BREAK = r"(?:[\s>\"',#*|]|\\[nrt])", r"(?:[\r\n]|\\[nr])"
_LINES = rf"(?:{_GAP}*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n\\]*+(?={_BREAK}))*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)*+(?:{_BREAK}++[ \t]*+[A-Za-z0-9+/]++={{0,2}}+(?=[ \t]*+(?:{_BREAK}|[\"'`]|\z)))?+"

#: kind: (pattern, group whose length is tested, least length, a short pattern that every finding holds, in any case).
#: The first three are the base kinds.
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "passw|secret|token|api_?key"),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    "hex": (r"[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
    "private": (rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_LINES})", 0, 1, "-----BEGIN "),
    "forge": (r"gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh[pousr]_"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30, "eyJ"),
    "chat": (r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, "xox[abprs]-"),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "rules-" + hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
#: A text that this pattern doesn't find holds no finding of any rule.
TRIGGER = "(?i)" + "|".join(hint for *_, hint in RULES.values())

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def before(values: Column, fold) -> Column:
    """For each number of an array, what ``fold`` (of two) makes of 0 and all numbers before it.

    Numbers are folded in chunks first, so the work stays near n * CHUNK for long arrays.
    """
    whole = lambda a: F.aggregate(a, F.lit(0), fold)
    chunk = lambda i: F.floor(i / CHUNK).cast("int")

    def within(v):
        chunks = F.transform(F.sequence(F.lit(0), chunk(F.size(v))), lambda c: whole(F.slice(v, c * CHUNK + 1, F.lit(CHUNK))))

        def with_starts(starts):
            return F.transform(v, lambda _, i: fold(F.get(starts, chunk(i)), whole(F.slice(v, chunk(i) * CHUNK + 1, i % CHUNK))))

        return let(chunks, lambda c: let(F.transform(c, lambda _, k: whole(F.slice(c, F.lit(1), k))), with_starts))

    return let(values, within)


CHUNK = 64


def spans(text: Column, rank: int, kind: str) -> Column:
    """The findings of a rule in a text: matches from the left, without overlap, of enough length.

    The pieces between matches and the matches themselves add up to positions, in
    code points.
    """
    pattern, group, least, _ = RULES[kind]
    if kind == "hex":  # a run is as long as it gets, so short ones need not be gathered
        pattern = r"[0-9a-f]{32,}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m):
        tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        steps = F.transform(F.arrays_zip(m.alias("m"), tested.alias("g"), between.alias("b")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))

        def spanned(v):
            at = before(F.transform(v, lambda x: x["b"] + x["m"]), lambda s, x: s + x)
            found = F.zip_with(v, at, lambda x, p: F.struct((p + x["b"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (p + x["b"] + x["m"]).alias("end"), x["g"].alias("g")))
            return F.transform(F.filter(found, lambda x: x["g"] >= least), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

        return let(steps, spanned)

    return let(whole, placed)


def scan_blobs(blobs: DataFrame) -> DataFrame:
    """Findings of each blob (blob_id, text): rows (blob_id, rule_version, found)."""
    none = F.array().cast(SPAN)
    every = F.array_sort(F.flatten(F.array(*(spans(F.col("text"), i, kind) for i, kind in enumerate(RULES)))))
    return blobs.select("blob_id", F.lit(RULE_VERSION).alias("rule_version"), F.when(F.col("text").rlike(TRIGGER), every).otherwise(none).alias("found"))


def contents(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, text, blob_id): null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keys, text.alias("__text")).select(*keys, F.col("__text").alias("text"), F.unhex(F.sha2("__text", 256)).alias("blob_id"))


LEDGER = f"blob_id binary, found {SPAN}, rule_version string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob_id, found, rule_version) of the ledger at ``path``; empty where nothing has been recorded."""
    return spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else spark.createDataFrame([], LEDGER)


def new_findings(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows of the blobs of ``rows`` (first, text, blob_id) that ``ledger`` lacks for this rule version.

    Of equal texts one is scanned: a row of the least ``first``.  The choice moves numbers
    and hashes only; texts move once, to meet it.
    """
    todo = rows.groupBy("blob_id").agg(F.min("first").alias("first"))
    todo = todo.join(ledger.where(F.col("rule_version") == RULE_VERSION).select("blob_id"), "blob_id", "left_anti")
    one = rows.join(todo.hint("shuffle_hash"), ["first", "blob_id"], "left_semi")
    return scan_blobs(one.select("blob_id", "text")).dropDuplicates(["blob_id"])


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _first(id_col: str) -> Column:
    """The id as a number that the scan's choice between equal texts goes by."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def scan_history(history: DataFrame, keys: list[str], ledger_path: str | None = None, text_col: str = "text", order: Column | None = None) -> DataFrame:
    """``keys``, blob_id and found of every row of ``history``: each version of each path, say.

    Only blobs that the ledger at ``ledger_path`` lacks under the present rules are
    scanned; what they hold is appended to it before the findings are joined back to all
    rows.  Without a path the ledger is a new one in the shared folder.  Null text is
    scanned as empty; equal texts share a blob and so their findings; repeated rows each
    get a row; other columns of ``history`` are left out.  ``order`` is a number by which one of equal
    texts is chosen for the scan; any will do, but it must not change when a task runs again.
    """
    spark = history.sparkSession
    path = ledger_path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = contents(history.withColumn("__order", F.xxhash64(*keys) if order is None else order), [*keys, "__order"], text_col)
    fresh = new_findings(rows.select("text", "blob_id", F.col("__order").alias("first")), read_ledger(spark, path))
    fresh.write.mode("append").partitionBy("rule_version").parquet(path)
    hits = read_ledger(spark, path).where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0)).select("blob_id", "found")
    return rows.select(*keys, "blob_id").join(hits, "blob_id", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN))).select(*keys, "blob_id", "found")


def scan_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Findings of every row of ``docs`` (doc_id, text), by ``scan_history``.

    doc_id, counts of the base kinds, the digest of base spans, and all spans as text and
    array.  Overlapping findings of different kinds all stay.
    """
    out = scan_history(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], ledger_path, order=_first("doc_id"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), "found", F.hex("blob_id").alias("blob_id"))


def redact(docs: DataFrame, mark: str = "[SECRET]", ledger_path: str | None = None) -> DataFrame:
    """``docs`` with every finding in the text replaced by ``mark``; all rows and columns stay.

    Where findings overlap their union is replaced once.  The ledger is used and kept as by
    ``scan_history``.  Null text stays null.
    """
    spark = docs.sparkSession
    path = ledger_path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = contents(docs.withColumn("__order", _first("doc_id")), ["__order"]).withColumnRenamed("__order", "first")
    new_findings(rows, read_ledger(spark, path)).write.mode("append").partitionBy("rule_version").parquet(path)
    hits = read_ledger(spark, path).where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0)).select(F.col("blob_id").alias("__blob"), F.col("found").alias("__found"))
    text = F.coalesce(F.col("text"), F.lit(""))
    held = docs.withColumn("__blob", F.unhex(F.sha2(text, 256)))
    # only rows that can hold a finding meet the ledger
    hot = held.where(text.rlike(TRIGGER)).join(hits, "__blob", "left")
    # findings stand in order of their start: one is marked if it starts where all before it have ended
    ends = F.transform("__found", lambda x: x["end"])
    # four bytes a code point, so that a place is found without counting from the text's start
    cut = lambda wide, start, size: F.decode(F.substring(wide, 4 * start + 1, 4 * size), "UTF-32")
    piece = lambda wide: lambda x, far: F.when(x["start"] >= far, F.concat(cut(wide, far, x["start"] - far), F.lit(mark))).otherwise("")
    whole = lambda wide: F.concat(F.array_join(F.zip_with("__found", before(ends, lambda s, x: F.greatest(s, x)), piece(wide)), ""), cut(wide, F.array_max(ends), F.length("text")))
    clean = let(F.encode("text", "UTF-32"), whole)
    hot = hot.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(clean))
    cold = held.where(~text.rlike(TRIGGER))
    return cold.select(*docs.columns).unionByName(hot.select(*docs.columns))
