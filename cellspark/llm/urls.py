"""URL filters: host and path rules, then a weighted vocabulary searched with Aho-Corasick."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual vocabulary: a term's weight.  A weight of 1 or more is strict: one hit rejects.  The others are soft: distinct hits
#: of weight 1 together reject, which two of these always are and one never is.
VOCABULARY = {
    **dict.fromkeys(("casino", "porn", "xxx", "adult", "viagra", "escort", "cheap-pills", "free-bets", "spam-farm", "ads-track", "warez"), 1.0),
    **dict.fromkeys(("free", "bets", "bet", "pills", "cheap", "win", "spam", "farm", "ads", "track", "poker", "loan", "crack", "torrent"), 0.5),
}
LIMIT = 1.0
#: Rules and terms go to every task with its code; more than this many are refused.
MOST_ENTRIES = 200_000


def parts(url):
    """(host, path) columns: what follows the first ``://``; both empty without one."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.when(has, F.regexp_extract(url, pattern, 1)).otherwise("")
    path = F.when(has, F.regexp_extract(url, pattern, 2)).otherwise("")
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Rules:
    """Allow and block rules by host; the longest that fits wins."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for action, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, action))
        if sum(map(len, self.by_host.values())) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} rules")

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        while host:
            for start, rule, action in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (len(rule), action) > (len(best[0]), best[1])):
                    best = (rule, action)
            host = host.partition(".")[2]
        return best


class Vocabulary:
    """Distinct strict terms, distinct soft terms and their summed weight in a url.

    A hit counts only between characters that are neither letters nor digits.
    """

    def __init__(self, terms: dict[str, float] = VOCABULARY):
        self.machine = ahocorasick.Automaton()
        low: dict[str, float] = {}
        for term, weight in terms.items():
            if term:
                low[term.lower()] = max(weight, low.get(term.lower(), 0.0))
        if len(low) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} terms")
        for term, weight in low.items():
            self.machine.add_word(term, (term, weight))
        if low:
            self.machine.make_automaton()

    def hits(self, url: str) -> tuple[list[str], list[str], float]:
        if not len(self.machine):
            return [], [], 0.0
        low = url.lower()
        strict, soft = set(), {}
        for end, (term, weight) in self.machine.iter(low):
            start = end - len(term) + 1
            if start and low[start - 1].isalnum() or end + 1 < len(low) and low[end + 1].isalnum():
                continue
            if weight >= LIMIT:
                strict.add(term)
            else:
                soft[term] = weight
        return sorted(strict), sorted(soft), float(sum(soft.values()))


def vocabulary(table: DataFrame) -> dict[str, float]:
    """The vocabulary in a table (term, weight), for ``filter_urls``; more than ``MOST_ENTRIES`` rows are refused.

    Null or empty terms and null or negative weights are left out; of a repeated term the
    highest weight counts.
    """
    rows = table.select(F.col("term").cast("string"), F.col("weight").cast("double")).where("length(term) > 0 and weight >= 0").groupBy("term").agg(F.max("weight")).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} terms")
    return {r[0]: r[1] for r in rows}


SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>, soft_weight double"


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = (), terms: dict[str, float] = VOCABULARY) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, the rule that fits, the verdict.

    ``rules`` are (allow or block, ``host/path``); a rule fits its host and all
    subdomains if the path starts with the rule's, and the longest wins (block
    before allow between equals).  Without a rule the vocabulary decides: one strict
    term, or distinct soft terms of weight 1 together, block; else allow.  A null
    url, or one without ``://``, has empty host and path and can match no rule;
    null counts as an empty text for the vocabulary.  An empty vocabulary blocks nothing.  The time
    follows a url's length.  No shuffle; repeated rows stay.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), "url")
    rules, terms = list(rules), dict(terms)
    Rules(rules), Vocabulary(terms)  # refuses too many at once

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, words = Rules(rules), Vocabulary(terms)
        for batch in batches:
            out: list[tuple] = []
            for h, p, url in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                rule = known.find(h, p)
                a, b, weight = words.hits(url or "")
                verdict = rule[1] if rule else "block" if a or weight >= LIMIT else "allow"
                out.append((rule and rule[0], verdict, a, b, weight))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_terms", "soft_terms", "soft_weight"])

    return rows.mapInArrow(task, SCHEMA)
