"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html, langid, lexical, minhash, packing, pieces, quality, secrets, suffixes, urls, whitening

URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_substrings(_table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), (85, 100)).drop("mark", "stays")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).drop("found")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_in_order(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"), html.train(spark))


def held_out() -> F.Column:
    """A quarter of the documents, by a hash of the id; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "margin")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.round_trip(docs).select("doc_id", "n_tokens", "ids", "round_trip")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).drop("deviation_exact")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(_table(spark, sf_dir, "documents"))
    found = lexical.search(index, _table(spark, sf_dir, "benchmark"))
    index.drop()
    return found


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_suffix_dedup, op3_minhash, op4_decontaminate, op5_secrets, op6_fingerprints, op7_quality, op8_html, op9_language, op10_pieces, op11_whitening, op12_packing, op13_search)}

#: op1: what SQL expresses without the vocabulary's automaton, term by term.
_TERMS = ", ".join(f"('{t}', {w})" for t, w in urls.VOCABULARY.items())
ORACLES = {
    "op1_url_filter": f"""
WITH p AS (
  SELECT page_id, url,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's') ELSE '' END AS path
  FROM pages),
rules(action, rule, rule_host, rule_path) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
hit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
terms(term, weight) AS (VALUES {_TERMS}),
bad AS (
  SELECT page_id,
    (SELECT coalesce(sum(weight), 0) FROM terms WHERE regexp_matches(lower(coalesce(url, '')), '(^|[^\\pL\\pN])' || term || '($|[^\\pL\\pN])')) AS weight
  FROM p)
SELECT p.page_id, p.host, p.path, hit.rule,
  coalesce(hit.action, CASE WHEN weight >= {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN bad USING (page_id) LEFT JOIN hit USING (page_id)""",
    "op13_search": f"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.PATTERN}') AS terms FROM documents),
total AS (SELECT count(*) AS docs, sum(len(terms)) AS terms FROM d WHERE len(terms) > 0),
i AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}'), '{lexical.PATTERN}')) AS term FROM benchmark)
  GROUP BY ALL),
p AS (SELECT place, doc_id, n, term, count(*) AS tf FROM (SELECT place, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY term),
s AS (
  SELECT place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n::HUGEINT * docs) // total.terms)::BIGINT))) AS s
  FROM p JOIN w USING (term), total),
f AS (SELECT item, item_id, place, doc_id, sum(times * s)::BIGINT AS score FROM i JOIN s USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST, place) AS rank FROM f WHERE score > 0) WHERE rank <= {lexical.TOP}""",
}
