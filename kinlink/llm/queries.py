"""The operators of this subpackage as queries over the tables of a folder, and SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import find_leaks
from .fingerprints import fingerprint_report
from .html_text import extract
from .language_id import identify
from .language_id import train as train_languages
from .licenses import scan
from .licenses import sql as licenses_sql
from .mixing import mix
from .quality import held_out, score, train
from .simhash import as_hex, near_duplicates
from .substring_dedup import dedup_substrings
from .url_filter import RULES, TWO_LABELS, judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn, share all words, and give at most three times what they have."""
    return mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, fingerprints linked at two differing bits or fewer."""
    found = near_duplicates(_read(spark, sf_dir, "documents"), n=3, radius=2)
    return found.select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")


@_query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words, in three batches of ascending doc_id; the index is compacted before the last."""
    return dedup_substrings(_read(spark, sf_dir, "documents"), report=True)


SQL["op3_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (SELECT doc_id, i, CASE WHEN count(*) OVER n = 13 THEN string_agg(word, ' ') OVER n END AS gram
      FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
f AS (SELECT gram, min(doc_id) AS low FROM g WHERE gram IS NOT NULL GROUP BY gram),
h AS (SELECT doc_id, i, coalesce(low < doc_id, false) AS hit FROM g LEFT JOIN f USING (gram)),
c AS (SELECT doc_id, i, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM w JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)
"""


@_query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned outside the fold whose crc32(doc_id) leaves 1 when divided by 3; scores every whole text."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "at", "edits")


@_query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the label of the same number says low quality or toxic."""
    labels = _read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge(_read(spark, sf_dir, "pages"), outcomes, rules=RULES).select("page_id", "host", "path", "rule", "verdict", "bad_low")


SQL["op4_url_filters"] = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM u LEFT JOIN o ON doc_id = page_id GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
t AS (SELECT *, CASE WHEN len(l) < 2 THEN host ELSE l[-2] || '.' || l[-1] END AS two FROM h1),
h2 AS (SELECT host, n, k, CASE WHEN two IN @@ THEN two ELSE l[-1] END AS suffix, CASE WHEN two IN @@ AND len(l) > 2 THEN l[-3] || '.' || two ELSE two END AS domain FROM t),
g AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS rate FROM h2),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h2 GROUP BY suffix, domain),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(g.rate) AS rate FROM d0, g GROUP BY suffix),
sm AS (SELECT sum(n * pow(k / n - rate, 2)) AS spread, sum(rate * (1 - rate)) AS noise, sum(n * rate * (1 - rate)) AS scale, sum(n) AS pages FROM s0 WHERE n > 0),
sw AS (SELECT CASE WHEN (spread - noise) / pages <= scale / pages / 1001 THEN 1000.0 ELSE least(greatest(scale / (spread - noise) - 1, 1.0), 1000.0) END AS m FROM sm),
s1 AS (SELECT suffix, (m * rate + k) / (m + n) AS rate FROM s0, sw),
d1 AS (SELECT d0.domain, d0.n, d0.k, s1.rate FROM d0 JOIN s1 USING (suffix)),
dm AS (SELECT sum(n * pow(k / n - rate, 2)) AS spread, sum(rate * (1 - rate)) AS noise, sum(n * rate * (1 - rate)) AS scale, sum(n) AS pages FROM d1 WHERE n > 0),
dw AS (SELECT CASE WHEN (spread - noise) / pages <= scale / pages / 1001 THEN 1000.0 ELSE least(greatest(scale / (spread - noise) - 1, 1.0), 1000.0) END AS m FROM dm),
d2 AS (SELECT domain, (m * rate + k) / (m + n) AS rate FROM d1, dw),
h3 AS (SELECT h2.host, h2.n, h2.k, d2.rate FROM h2 JOIN d2 USING (domain)),
hm AS (SELECT sum(n * pow(k / n - rate, 2)) AS spread, sum(rate * (1 - rate)) AS noise, sum(n * rate * (1 - rate)) AS scale, sum(n) AS pages FROM h3 WHERE n > 0),
hw AS (SELECT CASE WHEN (spread - noise) / pages <= scale / pages / 1001 THEN 1000.0 ELSE least(greatest(scale / (spread - noise) - 1, 1.0), 1000.0) END AS m FROM hm),
h4 AS (SELECT host, m * rate + k AS a, m * (1 - rate) + n - k AS b FROM h3, hw),
h5 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS low FROM h4),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT hp.host, hp.path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
         FROM (SELECT DISTINCT host, path FROM u) hp JOIN r ON (hp.host = h OR ends_with(hp.host, '.' || h)) AND starts_with(hp.path, p) GROUP BY hp.host, hp.path)
SELECT page_id, u.host, u.path, rule, coalesce(v, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(low, 6) AS bad_low
FROM u JOIN h5 ON h5.host = u.host LEFT JOIN best ON best.host = u.host AND best.path = u.path
""".replace("@@", str(TWO_LABELS))


@_query
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(_read(spark, sf_dir, "pages"))


@_query
def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence whose whole text a document is."""
    return scan(_read(spark, sf_dir, "documents"))


SQL["op7_license_scans"] = licenses_sql()


@_query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of texts and edited texts, and near documents of every 50th id."""
    return fingerprint_report(_read(spark, sf_dir, "documents"))


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; text models learned from the documents' languages."""
    return identify(_read(spark, sf_dir, "pages"), train_languages(_read(spark, sf_dir, "documents")))
