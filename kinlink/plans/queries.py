"""Queries over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import similarity as sim
from ..functions import pairs as pf
from ..functions import text, words
from ..model import PAIRS_SQL, RECORDS_SQL
from ..operators import blocking, context, decide, learn, sampling, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROUND = 6


def query(sql: str | None = None, pairs: bool = False, recs: bool = False):
    head = ", ".join(x for x, on in ((PAIRS_SQL, pairs), (RECORDS_SQL, recs)) if on)

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            SQL[f.__name__] = f"WITH {head}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}" if head else body
        return f

    return add


def _r(*cols: str):
    return [F.round(c, ROUND).alias(c) for c in cols]


_ASSIGNED = "assigned AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY p DESC, s1) AS k FROM pairs) WHERE k = 1)"
# the sound key of a lower-case word, step by step
_FOLDED = "t"
for _a, _b in (("ph", "f"), ("sh", "s"), ("ch", "s"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("dh", "d"), ("bh", "b"), ("jh", "j"), ("ck", "k"), ("x", "ks")):
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"
_TOKENS = f"""snd AS (SELECT id, country, src, array_to_string(list_filter(string_split(v, ''), lambda c, i: i = 1 OR c <> v[i - 1]), '') AS key FROM (
  SELECT id, country, src, w[1] || regexp_replace(substr(w, 2), '[aeiouyh]', '', 'g') AS v FROM (
    SELECT id, country, src, translate({_FOLDED}, 'cqgbdwzf', 'kkkptvjp') AS w FROM (SELECT id, country, src, unnest(name_toks) AS t FROM rec) WHERE regexp_matches(t, '^[a-z]+$')))),
fam AS MATERIALIZED (
  SELECT DISTINCT id, country, src, tok FROM (
    SELECT id, country, src, unnest(list_transform(addr_toks, lambda x: 'a|' || x)) AS tok FROM rec
    UNION ALL SELECT id, country, src, 'b|' || addr_toks[i] || ' ' || addr_toks[i + 1] FROM (SELECT id, country, src, addr_toks, unnest(generate_series(1, len(addr_toks) - 1)) AS i FROM rec WHERE len(addr_toks) > 1)
    UNION ALL SELECT id, country, src, 'n|' || t FROM (SELECT id, country, src, unnest(name_toks) AS t FROM rec) WHERE length(t) >= 2
    UNION ALL SELECT id, country, src, 'g|' || array_to_string(name_toks, '') FROM rec WHERE array_to_string(name_toks, '') <> ''
    UNION ALL SELECT id, country, src, 'p|' || key FROM snd WHERE length(key) >= 3
    UNION ALL SELECT id, country, src, 'i|' || array_to_string(list_transform(name_toks, lambda x: x[1]), '') FROM rec WHERE len(name_toks) >= 2
    UNION ALL SELECT id, country, src, 'i|' || array_to_string(name_toks, '') FROM rec WHERE length(array_to_string(name_toks, '')) BETWEEN 2 AND 6)),
cn AS (SELECT country, count(DISTINCT id) AS n FROM fam WHERE src = 1 GROUP BY country)"""
_COSINE = """df AS (SELECT country, tok, count(*) AS df FROM fam WHERE src = 1 GROUP BY ALL),
w AS MATERIALIZED (SELECT fam.*, coalesce(df, 0) AS df, ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM fam LEFT JOIN df USING (country, tok) JOIN cn USING (country)),
nm AS (SELECT src, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
u AS MATERIALIZED (SELECT w.country, tok, src, id, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS w FROM w JOIN nm USING (src, id) WHERE df > 0 AND df <= 1000),
cs AS MATERIALIZED (SELECT src, rec, s1, s_cos, CAST(k AS INT) AS s_rank FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY s_cos DESC, s1) AS k FROM (
  SELECT r.src, r.id AS rec, l.id AS s1, round(sum(l.w * r.w), 6) AS s_cos FROM u l JOIN u r ON l.country = r.country AND l.tok = r.tok AND l.src = 1 AND r.src <> 1 GROUP BY ALL)) WHERE k <= 10)"""
_OVERLAP = """ov AS MATERIALIZED (
  SELECT src, rec, s1, sp_score, CAST(k - 1 AS INT) AS sp_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY sp_score DESC, s1) AS k FROM (
      SELECT r.src, r.id AS rec, l.id AS s1, round(sum(ln(n / df)), 6) AS sp_score
      FROM (SELECT country, tok, count(*) AS df FROM fam WHERE src = 1 GROUP BY country, tok HAVING count(*) <= 200) d
      JOIN cn USING (country) JOIN fam l ON l.country = d.country AND l.tok = d.tok AND l.src = 1 JOIN fam r ON r.country = d.country AND r.tok = d.tok AND r.src <> 1
      GROUP BY r.src, r.id, l.id)) WHERE k <= 10)"""


@query(f"""WITH {_TOKENS}, {_OVERLAP}, best AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY sp_score DESC, s1) AS k FROM ov) WHERE k = 1 AND sp_score >= 20),
l AS (SELECT s1, string_agg('S' || src || '-' || rec, ',' ORDER BY src, rec) AS matched FROM (SELECT s1, src, rec FROM best) GROUP BY s1)
SELECT id AS s1, coalesce(matched, '') AS matched FROM rec LEFT JOIN l ON l.s1 = rec.id WHERE rec.src = 1""", recs=True)
def link_records(spark, d):
    """Flagship: shared rare tokens, one owner per record, a floor on the weight, one list per clean record."""
    recs = model.records(spark, d)
    toks = blocking.token_families(recs)
    found = blocking.overlap(toks, blocking.block_sizes(toks), last=True)
    matches = decide.assign(found, "sp_score").filter(F.col("sp_score") >= 20)
    return decide.match_lists(recs.filter(F.col("src") == 1).select(F.col("id").alias("s1")), matches)


@query(f"WITH {_TOKENS}, {_OVERLAP} SELECT * FROM ov", recs=True)
def blocking_overlap(spark, d):
    toks = blocking.token_families(model.records(spark, d))
    return blocking.overlap(toks, blocking.block_sizes(toks), last=True)


@query(f"WITH {_TOKENS}, {_COSINE} SELECT * FROM cs", recs=True)
def blocking_cosine(spark, d):
    toks = blocking.token_families(model.records(spark, d))
    return blocking.cosine(toks, blocking.block_sizes(toks), last=True)


def _vectors(spark, d):
    return model.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("block"), blocking.unit(F.col("embedding")).alias("vec"))


@query("""WITH v AS (SELECT vec_id AS id, label AS block, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT id, block, e, sqrt(list_inner_product(e, e)) AS n FROM v)
SELECT rec, s1, sim, CAST(k - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY sim DESC, s1) AS k FROM (
  SELECT a.id AS rec, b.id AS s1, round(list_inner_product(a.e, b.e) / (a.n * b.n), 5) AS sim FROM u a JOIN u b ON a.block = b.block AND a.id % 3 <> 0 AND b.id % 3 = 0)) WHERE k <= 10""")
def dense_nearest(spark, d):
    """Every third vector is a clean record; the others look for their ten nearest of the same label."""
    v = _vectors(spark, d)
    return blocking.nearest(v.filter(F.col("id") % 3 != 0), v.filter(F.col("id") % 3 == 0))


@query(f"""WITH {_TOKENS}, {_OVERLAP}, {_COSINE}
SELECT src, rec, s1, sim, coalesce(rank, 99) AS rank, coalesce(sp_score, 0) AS sp_score, coalesce(sp_rank, 99) AS sp_rank, CAST(rank IS NOT NULL AS INT) AS in_dense, CAST(sp_rank IS NOT NULL AS INT) AS in_sparse
FROM (SELECT src, rec, s1, s_cos AS sim, s_rank - 1 AS rank FROM cs WHERE s_rank <= 3) FULL JOIN (SELECT * FROM ov WHERE sp_rank < 5) USING (src, rec, s1)""", recs=True)
def candidate_union(spark, d):
    """Two whole channels, cosine and overlap, the first three ranks of one and five of the other, with where each pair comes from."""
    toks = blocking.token_families(model.records(spark, d))
    n = blocking.block_sizes(toks)
    dense, sparse = blocking.both_channels(toks, n, last=True)
    dense = dense.select("src", "rec", "s1", F.col("s_cos").alias("sim"), (F.col("s_rank") - 1).alias("rank"))
    return blocking.union(dense, sparse, dense_k=3, sparse_k=5)


@query(f"""WITH {_TOKENS}, {_OVERLAP}, tr AS (SELECT r.src, r.id AS rec, l.id AS s1, r.country FROM rec l JOIN rec r ON l.country = r.country AND l.name = r.name AND l.address = r.address AND l.src = 1 AND r.src <> 1),
h AS (SELECT tr.*, coalesce(sp_rank, 1073741824) AS k FROM tr LEFT JOIN ov USING (src, rec, s1))
SELECT country, src, count(*) AS n, round(avg(CAST(k < 1 AS INT)), 6) AS recall_1, round(avg(CAST(k < 3 AS INT)), 6) AS recall_3, round(avg(CAST(k < 5 AS INT)), 6) AS recall_5, round(avg(CAST(k < 10 AS INT)), 6) AS recall_10
FROM h GROUP BY GROUPING SETS ((), (country), (src))""", recs=True)
def recall_gate(spark, d):
    """Exact copies across lists are the true pairs."""
    recs = model.records(spark, d)
    key = F.sha2(F.concat_ws("\x01", "name", "address"), 256)
    left = recs.filter(F.col("src") == 1).select("country", key.alias("key"), F.col("id").alias("s1"))
    truth = recs.filter(F.col("src") != 1).select("country", key.alias("key"), "src", F.col("id").alias("rec")).join(left, ["country", "key"]).select("src", "rec", "s1", "country")
    return blocking.recall_gate(blocking_overlap(spark, d), truth)


_IDF = "df AS (SELECT country, tok, count(*) AS df FROM (SELECT DISTINCT id, country, unnest(addr_toks) AS tok FROM rec WHERE src = 1) GROUP BY ALL), n AS (SELECT country, count(*) AS n FROM rec WHERE src = 1 GROUP BY ALL)"


@query(f"WITH {_IDF} SELECT country, tok, df, round(ln(n) - ln(df), 6) AS idf FROM df JOIN n USING (country)", recs=True)
def token_idf(spark, d):
    return stats.idf(model.records(spark, d).filter(F.col("src") == 1), "addr_toks").withColumn("idf", F.round("idf", ROUND))


@query(f"""WITH {_IDF}, t AS (SELECT id, country, unnest(addr_toks) AS tok FROM rec)
SELECT id, count(*) AS n_toks, round(sum(coalesce(ln(n) - ln(df), ln(n))), 4) AS weight FROM t LEFT JOIN df USING (country, tok) JOIN n USING (country) GROUP BY id""", recs=True)
def idf_lists(spark, d):
    recs = model.records(spark, d)
    clean = recs.filter(F.col("src") == 1)
    lists = stats.idf_lists(recs, "addr_toks", stats.idf(clean, "addr_toks"), stats.sizes(clean))
    return lists.select("id", F.size("idfs").cast("long").alias("n_toks"), F.round(F.aggregate("idfs", F.lit(0.0), lambda a, x: a + x), 4).alias("weight"))


@query("SELECT country, array_to_string(name_toks, '') AS key, count(*) FILTER (src = 1) AS n_clean, count(*) FILTER (src <> 1) AS n_noisy FROM rec WHERE array_to_string(name_toks, '') <> '' GROUP BY ALL", recs=True)
def name_crowding(spark, d):
    return stats.crowding(model.records(spark, d), F.array_join("name_toks", ""))


@query("""WITH n AS (SELECT country, greatest(count(*) FILTER (src = 1), 1) AS n1, greatest(count(*) FILTER (src <> 1), 1) AS n23 FROM rec GROUP BY country),
t AS (SELECT DISTINCT id, country, src, unnest(addr_toks) AS tok FROM rec),
c AS (SELECT country, tok, count(*) FILTER (src = 1) / any_value(n1) AS r1, count(*) FILTER (src <> 1) / any_value(n23) AS r23 FROM t JOIN n USING (country) WHERE length(tok) >= 2 AND NOT regexp_matches(tok, '^[0-9]+$') GROUP BY country, tok)
SELECT country, tok, round(r1, 6) AS r1, round(r23, 6) AS r23 FROM c WHERE r23 >= 0.002 AND (r23 + 1e-5) / (r1 + 1e-5) >= 1.5""", recs=True)
def filler_words(spark, d):
    return stats.fillers(model.records(spark, d), "addr_toks").withColumns({c: F.round(c, ROUND) for c in ("r1", "r23")})


@query("""WITH t AS (SELECT country, tok, count(*) AS df FROM (SELECT DISTINCT id, country, unnest(name_toks) AS tok FROM rec) GROUP BY ALL), n AS (SELECT country, count(*) AS n FROM rec GROUP BY ALL)
SELECT country, tok, round(df / n, 6) AS share FROM t JOIN n USING (country) WHERE df / n > 0.004""", recs=True)
def common_tokens(spark, d):
    return stats.common_tokens(model.records(spark, d), "name_toks").withColumn("share", F.round("share", ROUND))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY p DESC, s1) AS k FROM pairs)
SELECT s1, src, rec, round(p - max(p) OVER q, 6) AS gap_q_best, round(max(p) OVER q - coalesce(max(CASE WHEN k = 2 THEN p END) OVER q, 0), 6) AS q_margin,
 round(p - max(p) OVER s, 6) AS gap_s1_best, count(*) OVER s AS s1_ncand, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, src, rec) - 1 AS s1_rank
FROM w WINDOW q AS (PARTITION BY src, rec), s AS (PARTITION BY s1)""", pairs=True)
def competition(spark, d):
    out = context.competition(model.scored_pairs(spark, d))
    return out.select("s1", "src", "rec", *_r("gap_q_best", "q_margin", "gap_s1_best"), "s1_ncand", F.col("s1_rank").cast("long").alias("s1_rank"))


@query("""WITH t AS (SELECT src, rec, list_sort(list(p), 'DESC')[1:2] AS t, count(*) AS q_ncand FROM pairs GROUP BY ALL),
o AS (SELECT s1, src, rec, p, q_ncand, coalesce(CASE WHEN p >= t[1] THEN t[2] ELSE t[1] END, -1) AS other FROM pairs JOIN t USING (src, rec))
SELECT s1, src, rec, q_ncand, round(other, 6) AS other, round(CASE WHEN other < -0.5 THEN 99 ELSE p - other END, 6) AS other_gap FROM o""", pairs=True)
def record_block(spark, d):
    return context.record_block(model.scored_pairs(spark, d)).select("s1", "src", "rec", "q_ncand", *_r("other", "other_gap"))


@query("""SELECT s1, src, rec, round(max(p) OVER s, 6) AS s1_max_p, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, src, rec) AS p_rank_s1,
 sum(CAST(p > 0.9 AS INT)) OVER s - CAST(p > 0.9 AS INT) AS s1_cnt90_other, sum(CAST(p > 0.5 AS INT)) OVER s - CAST(p > 0.5 AS INT) AS s1_cnt50_other,
 round(sum(p) OVER s - p, 4) AS s1_sum_other, count(*) OVER s AS s1_ncand FROM pairs WINDOW s AS (PARTITION BY s1)""", pairs=True)
def group_context(spark, d):
    out = context.group_context(model.scored_pairs(spark, d))
    return out.select("s1", "src", "rec", *_r("s1_max_p"), F.col("p_rank_s1").cast("long").alias("p_rank_s1"), "s1_cnt90_other", "s1_cnt50_other", F.round("s1_sum_other", 4).alias("s1_sum_other"), "s1_ncand")


@query("""WITH w AS (SELECT *, row_number() OVER o AS k, lead(src) OVER o AS src2, lead(rec) OVER o AS rec2, lead(p) OVER o AS p2, first_value(src) OVER o AS src1, first_value(rec) OVER o AS rec1, first_value(p) OVER o AS p1
  FROM pairs WINDOW o AS (PARTITION BY s1 ORDER BY p DESC, src, rec)),
o AS (SELECT s1, src, rec, CASE WHEN k = 1 THEN src2 ELSE src1 END AS osrc, CASE WHEN k = 1 THEN rec2 ELSE rec1 END AS orec, CASE WHEN k = 1 THEN p2 ELSE p1 END AS op FROM w)
SELECT s1, src, rec, round(coalesce(op, -1), 6) AS anc_p, CASE WHEN op > 0.5 THEN orec END AS anc_rec, CASE WHEN op > 0.5 THEN osrc END AS anc_src,
 CASE WHEN op > 0.5 THEN CAST(osrc = src AS INT) ELSE -1 END AS anc_same_src, CAST(coalesce(op > 0.5, false) AS INT) AS has_anchor FROM o""", pairs=True)
def anchors(spark, d):
    return context.anchors(model.scored_pairs(spark, d)).select("s1", "src", "rec", *_r("anc_p"), "anc_rec", "anc_src", "anc_same_src", "has_anchor")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY p DESC, s1) AS rk_ours, row_number() OVER (PARTITION BY src, rec ORDER BY q DESC, s1) AS rk_his FROM pairs)
SELECT s1, src, rec, round(ln(p / (1 - p)), 6) AS z_ours, round(ln(q / (1 - q)), 6) AS z_his, rk_ours, rk_his,
 round(p - coalesce(CASE WHEN rk_ours = 1 THEN max(CASE WHEN rk_ours = 2 THEN p END) OVER r ELSE max(p) OVER r END, 0), 6) AS gap_ours,
 round(q - coalesce(CASE WHEN rk_his = 1 THEN max(CASE WHEN rk_his = 2 THEN q END) OVER r ELSE max(q) OVER r END, 0), 6) AS gap_his, count(*) OVER r AS n_rec
FROM (SELECT * REPLACE (least(greatest(p, 1e-7), 1 - 1e-7) AS p, least(greatest(q, 1e-7), 1 - 1e-7) AS q) FROM k) WINDOW r AS (PARTITION BY src, rec)""", pairs=True)
def stack_context(spark, d):
    out = context.stack_context(model.scored_pairs(spark, d))
    return out.select("s1", "src", "rec", *_r("z_ours", "z_his"), *(F.col(c).cast("long").alias(c) for c in ("rk_ours", "rk_his")), *_r("gap_ours", "gap_his"), "n_rec")


def _entities(spark, d):
    return model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1"))


_LISTS = "SELECT s_suppkey AS s1, coalesce(matched, '') AS matched FROM supplier LEFT JOIN (SELECT s1, string_agg('S' || src || '-' || rec, ',' ORDER BY src, rec) AS matched FROM {} GROUP BY s1) l ON l.s1 = s_suppkey"


@query(f"WITH {_ASSIGNED}, kept AS (SELECT * FROM assigned WHERE p >= 0.9) {_LISTS.format('kept')}", pairs=True)
def match_lists(spark, d):
    """One owner per record, one threshold, a list for every entity."""
    return decide.match_lists(_entities(spark, d), decide.by_threshold(decide.assign(model.scored_pairs(spark, d)), 0.9))


@query("SELECT s1, count(*) AS n, string_agg('S' || src || '-' || rec, ',' ORDER BY src, rec) AS matched FROM pairs GROUP BY s1", pairs=True)
def candidate_lists(spark, d):
    pairs = model.scored_pairs(spark, d)
    n = pairs.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    return decide.match_lists(pairs.select("s1"), pairs).join(n, "s1").select("s1", "n", "matched")


@query(f"WITH {_ASSIGNED} SELECT s1, src, rec, round(p, 6) AS p FROM assigned WHERE p >= CASE src WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE 0.99 END", pairs=True)
def group_thresholds(spark, d):
    a = decide.assign(model.scored_pairs(spark, d))
    return decide.by_threshold(a, decide.group_threshold(F.col("src"), {2: 0.8, 3: 0.7})).select("s1", "src", "rec", *_r("p"))


@query(f"""WITH {_ASSIGNED}, r AS (SELECT *, count(*) OVER u AS m, sum(p) OVER u AS c, sum(p) OVER s + 0.1 AS t, exp(sum(ln(greatest(1 - p, 1e-9))) OVER s) AS none FROM assigned WHERE p >= 0.15
  WINDOW s AS (PARTITION BY s1), u AS (PARTITION BY s1 ORDER BY p DESC, src, rec ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, round(1.25 * c / (1.25 * c + 0.25 * (t - c) + (m - c)), 9) AS ef FROM r),
b AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM e), z AS (SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY s1) AS most FROM b)
SELECT s1, src, rec, round(p, 6) AS p FROM z WHERE m <= most AND best > none AND p >= 0.3""", pairs=True)
def expected_f(spark, d):
    return decide.expected_f(decide.assign(model.scored_pairs(spark, d))).select("s1", "src", "rec", *_r("p"))


_COUNTS = """b AS (SELECT s1, count(*) FILTER (a AND y) AS tp, count(*) FILTER (a) AS np, count(*) FILTER (y) AS nt FROM (SELECT s1, src, rec, bool_or(a) AS a, bool_or(y) AS y FROM (
  SELECT s1, src, rec, true AS a, false AS y FROM kept UNION ALL SELECT s1, src, rec, false, true FROM pairs WHERE y = 1) GROUP BY ALL) GROUP BY s1),
f AS (SELECT s_suppkey AS s1, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM supplier LEFT JOIN b ON b.s1 = s_suppkey)"""
_F = "CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END"


@query(f"WITH {_ASSIGNED}, kept AS (SELECT * FROM assigned WHERE p >= 0.7), {_COUNTS} SELECT count(*) AS n, round(avg({_F}), 6) AS macro_f05 FROM f", pairs=True)
def macro_f05(spark, d):
    pairs = model.scored_pairs(spark, d)
    return decide.macro_f(_entities(spark, d), decide.by_threshold(decide.assign(pairs), 0.7), pairs.filter(F.col("y") == 1))


@query(f"""WITH {_ASSIGNED}, g AS (SELECT round(0.5 + 0.025 * i, 3) AS threshold FROM generate_series(0, 18) t(i)), nt AS (SELECT s1, count(*) AS nt FROM pairs WHERE y = 1 GROUP BY s1),
c AS (SELECT threshold, s1, count(*) AS np, sum(y) AS tp FROM assigned JOIN g ON p >= threshold GROUP BY ALL),
f AS (SELECT g.threshold, s_suppkey, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM g CROSS JOIN supplier LEFT JOIN c ON c.threshold = g.threshold AND c.s1 = s_suppkey LEFT JOIN nt ON nt.s1 = s_suppkey)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg({_F}), 6) AS macro_f05 FROM f GROUP BY threshold""", pairs=True)
def tune_threshold(spark, d):
    pairs = model.scored_pairs(spark, d)
    return decide.tune(_entities(spark, d), decide.assign(pairs), pairs.filter(F.col("y") == 1))


@query(f"""WITH {_ASSIGNED}, g AS (SELECT CAST(i AS DOUBLE) / 100 AS delta FROM generate_series(0, 29) t(i))
SELECT delta, round(sum(CAST(p >= least(CASE src WHEN 2 THEN 0.6 WHEN 3 THEN 0.5 ELSE 0.99 END + delta, 0.995) AS INT)) / (SELECT CAST(count(*) AS DOUBLE) FROM supplier), 6) AS mean_matches FROM assigned, g GROUP BY delta""", pairs=True)
def count_calibration(spark, d):
    n = _entities(spark, d).count()
    return decide.calibration_curve(decide.assign(model.scored_pairs(spark, d)), n, {2: 0.6, 3: 0.5}, F.col("src"), [i / 100 for i in range(30)])


@query("""WITH o AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6)) AS o FROM pairs)
SELECT s1, src, rec, round(o / (1 + sum(o) OVER (PARTITION BY src, rec)), 6) AS share FROM o""", pairs=True)
def one_owner_shares(spark, d):
    return decide.renormalise(model.scored_pairs(spark, d)).select("s1", "src", "rec", *_r("share"))


@query(f"""WITH {_ASSIGNED}, kept AS (SELECT * FROM assigned WHERE p >= 0.7), m AS (SELECT t.*, k.s1 IS NOT NULL AS found FROM (SELECT * FROM pairs WHERE y = 1) t LEFT JOIN kept k USING (s1, src, rec))
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN p < 0.7 THEN 'fn_low_score' ELSE 'fn_other_owner' END AS kind FROM m WHERE NOT found
 UNION ALL SELECT CASE WHEN EXISTS (SELECT 1 FROM pairs t WHERE t.y = 1 AND t.src = kept.src AND t.rec = kept.rec) THEN 'fp_competition' ELSE 'fp_orphan' END FROM kept WHERE y = 0) GROUP BY kind""", pairs=True)
def error_kinds(spark, d):
    pairs = model.scored_pairs(spark, d)
    return decide.error_kinds(pairs, decide.by_threshold(decide.assign(pairs), 0.7), pairs.filter(F.col("y") == 1), 0.7)


@query("""WITH a AS (SELECT * FROM pairs WHERE p >= 0.3), b AS (SELECT * FROM pairs WHERE q >= 0.5)
SELECT s1, src, rec, round((coalesce(a.p, 0) + coalesce(b.q, 0)) / 2, 6) AS p, CAST(a.p IS NOT NULL AS INT) AS has_ours, CAST(b.q IS NOT NULL AS INT) AS has_his FROM a FULL JOIN b USING (s1, src, rec)""", pairs=True)
def score_merge(spark, d):
    """Two systems' scores above their floors, averaged with missing as zero."""
    pairs, k = model.scored_pairs(spark, d), ["s1", "src", "rec"]
    both = pairs.filter(F.col("p") >= 0.3).select(*k, "p").join(pairs.filter(F.col("q") >= 0.5).select(*k, "q"), k, "full")
    return both.select(*k, F.round((F.coalesce("p", F.lit(0.0)) + F.coalesce("q", F.lit(0.0))) / 2, ROUND).alias("p"), F.col("p").isNotNull().cast("int").alias("has_ours"), F.col("q").isNotNull().cast("int").alias("has_his"))


@query("SELECT s1, src, rec, round(p, 6) AS p FROM pairs WHERE NOT EXISTS (SELECT 1 FROM pairs b WHERE b.s1 = pairs.s1 AND b.p > 0.999 AND b.src = 2) AND EXISTS (SELECT 1 FROM pairs c WHERE c.rec = pairs.rec AND c.src = pairs.src AND c.q > 0.5)", pairs=True)
def uncovered_entities(spark, d):
    """Anti join on covered entities, semi join on records the other system believes in."""
    pairs = model.scored_pairs(spark, d)
    covered = pairs.filter((F.col("p") > 0.999) & (F.col("src") == 2)).select("s1")
    believed = pairs.filter(F.col("q") > 0.5).select("src", "rec")
    return pairs.join(covered, "s1", "left_anti").join(believed, ["src", "rec"], "left_semi").select("s1", "src", "rec", *_r("p"))


@query(f"WITH {_ASSIGNED}, kept AS (SELECT * FROM assigned WHERE p >= CASE WHEN country % 5 = 0 THEN 0.95 ELSE 0.8 END) {_LISTS.format('kept')}", pairs=True)
def result_patch(spark, d):
    """Lists of one threshold, replaced for some countries by those of another."""
    pairs, ent = decide.assign(model.scored_pairs(spark, d)), _entities(spark, d)
    base = decide.match_lists(ent, decide.by_threshold(pairs, 0.8)).join(model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1"), "s_nationkey"), "s1")
    return decide.patch(base, decide.match_lists(ent, decide.by_threshold(pairs, 0.95)), F.col("s_nationkey") % 5 == 0).select("s1", "matched")


@query("SELECT s1, rec, CAST(floor(CAST('0x' || substr(md5('fold|' || s1), 1, 8) AS BIGINT) / 4294967296.0 * 2) AS INT) AS fold, CAST(((CAST(s1 AS HUGEINT) * 2654435761) % 1000003) % 2 AS INT) AS mfold FROM pairs", pairs=True)
def hash_folds(spark, d):
    return model.scored_pairs(spark, d).select("s1", "rec", sampling.fold("fold", "s1").alias("fold"), sampling.multiplicative_fold(F.col("s1")).alias("mfold"))


@query("""WITH h AS (SELECT *, CASE WHEN p >= 0.6 THEN 0.6 ELSE 0.3 END AS rate, CAST('0x' || substr(md5('neg|' || rec || '|' || s1), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM pairs)
SELECT s1, src, rec, y, round(CASE WHEN y = 1 THEN 1 ELSE 1 / rate END, 6) AS weight FROM h WHERE y = 1 OR u < rate""", pairs=True)
def negative_sampling(spark, d):
    out = sampling.subsample(model.scored_pairs(spark, d), easy=0.3, hard=0.6, is_hard=F.col("p") >= 0.6)
    return out.select("s1", "src", "rec", "y", *_r("weight"))


@query("SELECT country, round(x, 6) AS x, i FROM (SELECT country, unnest(q) AS x, unnest(generate_series(0, 200)) AS i FROM (SELECT country, quantile_cont(p, list_transform(generate_series(0, 200), k -> k / 200)) AS q FROM pairs GROUP BY country))".replace("list_transform(generate_series(0, 200), k -> k / 200)", "[" + ", ".join(str(i / 200) for i in range(201)) + "]"), pairs=True)
def quantile_knots(spark, d):
    out = stats.quantiles(model.scored_pairs(spark, d), "country", "p")
    return out.select("country", F.posexplode("knots").alias("i", "x")).select("country", F.round("x", ROUND).alias("x"), F.col("i").cast("long").alias("i"))


@query("""WITH q AS (SELECT country, quantile_cont(p, [@@]) AS ks FROM pairs GROUP BY country), n AS (SELECT pairs.*, ks, len(list_filter(ks, lambda v: v <= p)) AS pos FROM pairs JOIN q USING (country))
SELECT s1, src, rec, round(CASE WHEN pos = 0 THEN 0 WHEN pos >= 201 THEN 1 ELSE (pos - 1 + CASE WHEN ks[pos + 1] > ks[pos] THEN (p - ks[pos]) / (ks[pos + 1] - ks[pos]) ELSE 0 END) / 200 END, 5) AS pct FROM n""".replace("@@", ", ".join(str(i / 200) for i in range(201))), pairs=True)
def quantile_mapping(spark, d):
    pairs = model.scored_pairs(spark, d)
    return stats.quantile_map(pairs, "country", "p", stats.quantiles(pairs, "country", "p")).select("s1", "src", "rec", F.round("pct", 5).alias("pct"))


@query("""WITH b AS (SELECT count(*) AS n, round(avg(y), 6) AS pos_rate, round(avg(-(y * ln(x) + (1 - y) * ln(1 - x))), 6) AS logloss, round(avg(CAST(CAST(p >= 0.5 AS INT) = y AS INT)), 6) AS accuracy FROM (SELECT *, least(greatest(p, 1e-7), 1 - 1e-7) AS x FROM pairs)),
g AS (SELECT round(p, 6) AS s, sum(y) AS pos, sum(1 - y) AS neg FROM pairs GROUP BY 1), w AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
SELECT b.*, round((SELECT sum(pos * (b + neg / 2)) / (sum(pos) * sum(neg)) FROM w), 6) AS auc FROM b""", pairs=True)
def model_metrics(spark, d):
    return learn.metrics(model.scored_pairs(spark, d), "p", "y")


@query("SELECT country, count(*) AS n, round(avg(CAST(np = 0 AS INT)), 6) AS empty, round(avg(np), 6) AS mean, any_value(med) AS median_p FROM (SELECT s_suppkey, s_nationkey AS country, count(k.s1) AS np FROM supplier LEFT JOIN (SELECT * FROM pairs WHERE p >= 0.9) k ON k.s1 = s_suppkey GROUP BY ALL) LEFT JOIN (SELECT country, round(median(p), 6) AS med FROM pairs WHERE p >= 0.9 GROUP BY country) USING (country) GROUP BY country", pairs=True)
def country_report(spark, d):
    ent = model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1"), F.col("s_nationkey").alias("country"))
    kept = model.scored_pairs(spark, d).filter(F.col("p") >= 0.9)
    n = ent.join(kept.groupBy("s1").agg(F.count(F.lit(1)).alias("np")), "s1", "left").na.fill(0, ["np"])
    out = n.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("np") == 0).cast("double")), 6).alias("empty"), F.round(F.avg("np"), 6).alias("mean"))
    middle = stats.quantiles(kept, "country", "p", 3).select("country", F.round(F.element_at("knots", 2), 6).alias("median_p"))
    return out.join(middle, "country", "left")


@query("""WITH a AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS t FROM part)
SELECT p_partkey, levenshtein(n, t) AS edits, round(CASE WHEN greatest(length(n), length(t)) = 0 THEN 1 ELSE 1 - levenshtein(n, t) / greatest(length(n), length(t)) END, 6) AS lev_sim,
 round(len(list_intersect(string_split(n, ' '), string_split(t, ' '))) / len(list_distinct(list_concat(string_split(n, ' '), string_split(t, ' ')))), 6) AS jac FROM a""")
def edit_and_set_similarity(spark, d):
    a = model.table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("t"))
    n, t = F.col("n"), F.col("t")
    return a.select("p_partkey", F.levenshtein("n", "t").cast("long").alias("edits"), F.round(sim.levenshtein_similarity(n, t), ROUND).alias("lev_sim"), F.round(sim.jaccard(F.split(n, " "), F.split(t, " ")), ROUND).alias("jac"))


@query("SELECT c_custkey, round(jaro_winkler_similarity(lower(c_name), lower(c_mktsegment)), 6) AS jw FROM customer")
def jaro_winkler(spark, d):
    c = model.table(spark, d, "customer")
    return c.select("c_custkey", F.round(sim.jaro_winkler_udf(F.lower("c_name"), F.lower("c_mktsegment")), ROUND).alias("jw"))


@query()
def string_ratios(spark, d):
    """The Indel family, batched."""
    a = model.table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("t"))
    n, t = F.col("n"), F.col("t")
    return a.select("p_partkey", F.round(sim.ratio_udf(n, t), 4).alias("ratio"), F.round(sim.token_sort_udf(n, t), 4).alias("token_sort"), F.round(sim.token_set_udf(n, t), 4).alias("token_set"), F.round(sim.partial_udf(n, t), 4).alias("partial"))


@query("""WITH r AS (SELECT c_custkey, list_transform(regexp_extract_all(c_name, '[0-9]+'), lambda x: regexp_replace(x, '^0+([0-9])', '\\1')) AS a0,
  list_transform([CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR)], lambda x: x) AS b0 FROM customer),
n AS (SELECT c_custkey, a0 AS a, CASE WHEN b0[1] = b0[2] THEN b0[1:1] ELSE b0 END AS b FROM r),
e AS (SELECT c_custkey, min(levenshtein(x, y)) AS m FROM (SELECT c_custkey, x, unnest(b) AS y FROM (SELECT c_custkey, unnest(a) AS x, b FROM n)) GROUP BY 1)
SELECT c_custkey, CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(a[1] = b[1] AS INT) ELSE -1 END AS first_equal,
 CASE WHEN len(a) > 0 AND len(b) > 0 THEN CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS INT) ELSE -1 END AS subset,
 CASE WHEN len(list_filter(a, lambda x: length(x) >= 5)) > 0 AND len(list_filter(b, lambda x: length(x) >= 5)) > 0 THEN CAST(list_has_any(list_filter(a, lambda x: length(x) >= 5), list_filter(b, lambda x: length(x) >= 5)) AS INT) ELSE -1 END AS code_equal,
 coalesce(m, 9) AS min_edits, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS missing FROM n LEFT JOIN e USING (c_custkey)""")
def number_features(spark, d):
    c = model.table(spark, d, "customer").select("c_custkey", text.numbers(F.array(F.col("c_name"))).alias("a"), text.numbers(F.array(F.concat(F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_custkey").cast("string")))).alias("b"))
    return c.select("c_custkey", sim.number_features(F.col("a"), F.col("b")).alias("f")).select("c_custkey", *(F.col(f"f.{x}").cast("long").alias(x) for x in ("first_equal", "subset", "code_equal", "min_edits", "missing")))


@query()
def normalised_records(spark, d):
    return text.normalise(model.records(spark, d).select("id", "country", "src", "name", "address"))


@query("""WITH h AS (SELECT id, name, CAST('0x' || substr(md5('aug|' || id), 1, 8) AS BIGINT) / 4294967296.0 AS u, floor(CAST('0x' || substr(md5('kind|' || id), 1, 8) AS BIGINT) / 4294967296.0 * 4) AS kind FROM rec),
t AS (SELECT *, list_filter(string_split(name, ' '), lambda x: x <> '') AS toks FROM h)
SELECT id, md5(name) AS name, md5(CASE WHEN u >= 0.12 THEN name WHEN kind = 0 THEN upper(array_to_string(list_transform(toks, lambda x: x[1]), ''))
 WHEN kind = 1 THEN translate(name, 'àâäáãçéèêëíìîïñóòôöõúùûü', 'aaaaaceeeeiiiinooooouuuu') WHEN kind = 2 THEN name || ' (' || lpad(CAST(CAST(floor(u * 1e6) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ')'
 ELSE array_to_string(list_transform(toks, lambda x: CASE WHEN length(x) > 6 THEN x[1:4] || '.' ELSE x END), ' ') END) AS noisy FROM t""", recs=True)
def augmented_names(spark, d):
    """Digests of names and of what noise makes of them."""
    out = sampling.augment(model.records(spark, d).select("id", "name"), "name")
    return out.select("id", F.md5(F.col("name").cast("binary")).alias("name"), F.md5(F.col("noisy").cast("binary")).alias("noisy"))


@query()
def stacked_scores(spark, d):
    """Two-fold out-of-fold boosted trees over the stack context."""
    out = context.stack_context(model.scored_pairs(spark, d))
    return learn.out_of_fold(out, ["z_ours", "z_his", "rk_ours", "rk_his", "gap_ours", "gap_his", "n_rec"], lambda x: learn.fit_trees(x, rounds=5, depth=3)).select("s1", "src", "rec", F.round("oof", 4).alias("oof"))


@query()
def blended_scores(spark, d):
    data = learn.assembled(decide.blend_features(model.scored_pairs(spark, d)), ["la", "lb", "lab"])
    return learn.scores(learn.fit_blend(data), data, "blend").select("s1", "src", "rec", F.round("blend", 4).alias("blend"))


@query()
def text_vectors(spark, d):
    """Character n-grams in word bounds of names, 2**20 buckets, TF-IDF; eight SVD dimensions by two rounds."""
    v = learn.project(learn.tfidf(model.records(spark, d).select("id", "name"), "name"), rounds=2)
    return v.select("id", F.size("vec").alias("dims"), F.round(F.sqrt(blocking.dot(F.col("vec"), F.col("vec"))), 3).alias("norm"))


@query(r"""WITH w AS (SELECT p_partkey AS id, unnest(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) AS w FROM part),
p AS (SELECT id, ' ' || w || ' ' AS x FROM w),
g AS (SELECT id, x[i:i + k - 1] AS gram FROM (SELECT id, x, k, unnest(generate_series(1, length(x) - k + 1)) AS i FROM p, (VALUES (2), (3), (4)) v(k) WHERE length(x) > k) UNION ALL SELECT id, x FROM p WHERE length(x) <= 4),
t AS (SELECT id, gram, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) / (1 + count(*))) + 1 AS idf FROM t GROUP BY gram)
SELECT id, count(*) AS grams, round(sum(ln(1 + tf) * idf), 4) AS weight FROM t JOIN d USING (gram) GROUP BY id""")
def gram_weights(spark, d):
    """N-grams of parts' names with their TF-IDF weights, before they are hashed."""
    parts = model.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("t"))
    return learn.gram_weights(parts, "t").withColumn("weight", F.round("weight", 4))


_CROSSED = """c0 AS (SELECT id, country, src, list_filter(name_toks, lambda x: length(x) > 1)[1:4] AS n, list_filter(addr_toks, lambda x: length(x) > 1 AND NOT regexp_matches(x, '[0-9]'))[1:8] AS a,
  list_filter(list_transform(addr_toks, lambda x: ltrim(regexp_replace(x, '[^0-9]', '', 'g'), '0')), lambda x: x <> '')[1:3] AS d, array_to_string(name_toks, '') AS j FROM rec),
n AS (SELECT id, unnest(n) AS x, generate_subscripts(n, 1) AS i FROM c0), a AS (SELECT id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM c0), d AS (SELECT id, unnest(d) AS x FROM c0),
fam AS (SELECT DISTINCT id, country, src, tok FROM c0 JOIN (
  SELECT id, 'n:' || x AS tok FROM n UNION ALL SELECT id, 'a:' || x FROM a UNION ALL SELECT id, 'd:' || x FROM d UNION ALL SELECT id, 'j:' || j FROM c0 WHERE length(j) >= 4
  UNION ALL SELECT id, 'x:' || d.x || '_' || a.x FROM d JOIN a USING (id) UNION ALL SELECT id, 'y:' || n.x || '_' || d.x FROM n JOIN d USING (id)
  UNION ALL SELECT id, 'c:' || n.x || '_' || a.x FROM n JOIN a USING (id) WHERE n.i <= 3 AND a.i <= 6) t USING (id)),
cn AS (SELECT country, count(DISTINCT id) AS n FROM fam WHERE src = 1 GROUP BY country)"""
_WEIGHTED = """df AS (SELECT country, tok, count(*) AS df FROM fam WHERE src = 1 GROUP BY ALL),
w AS (SELECT fam.*, coalesce(df, 0) AS df, ln((n + 1) / (coalesce(df, 0) + 1)) AS w FROM fam LEFT JOIN df USING (country, tok) JOIN cn USING (country)),
nm AS (SELECT src, id, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
u AS (SELECT w.country, tok, src, id, df, CASE WHEN norm > 0 THEN w / norm ELSE 0 END AS w FROM w JOIN nm USING (src, id))"""


def _crossed(spark, d):
    recs = model.records(spark, d).withColumn("w", words.address_only_words(F.col("addr_toks"))).withColumn("d", text.glued_numbers(F.col("addr_toks")))
    return blocking.crossed_tokens(recs, core="name_toks", words_="w", nums="d")


@query(f"WITH {_CROSSED} SELECT * FROM fam", recs=True)
def crossed_tokens(spark, d):
    """Name words, address words and numbers, alone and in pairs."""
    return _crossed(spark, d)


@query(f"""WITH {_CROSSED}, {_WEIGHTED}
SELECT src, rec, s1, s_cos, CAST(k AS INT) AS s_rank FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY s_cos DESC, s1) AS k FROM (
  SELECT r.src, r.id AS rec, l.id AS s1, round(sum(l.w * r.w), 6) AS s_cos FROM u l JOIN u r ON l.country = r.country AND l.tok = r.tok AND l.src = 1 AND r.src <> 1 AND l.df <= 1000 GROUP BY ALL)) WHERE k <= 10""", recs=True)
def crossed_cosine(spark, d):
    toks = _crossed(spark, d)
    return blocking.cosine(toks, blocking.block_sizes(toks))


@query(f"""WITH {_TOKENS}, {_OVERLAP}, {_WEIGHTED}
SELECT ov.src, ov.rec, ov.s1, round(sum(l.w * r.w), 6) AS cos FROM ov JOIN u r ON r.src = ov.src AND r.id = ov.rec JOIN u l ON l.src = 1 AND l.id = ov.s1 AND l.tok = r.tok GROUP BY ALL""", recs=True)
def pair_cosine(spark, d):
    """Cosine over all tokens for the pairs that overlap found."""
    toks = blocking.token_families(model.records(spark, d))
    return blocking.overlap_cosine(toks, blocking.block_sizes(toks), last=True)


@query("""WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), v AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS n FROM u)
SELECT a.id AS rec, b.id AS s1, CASE WHEN a.id % 2 = 0 THEN 0.25 ELSE round(list_inner_product(a.e, b.e) / (a.n * b.n), 5) END AS sim FROM v a JOIN v b ON b.id = a.id + 7""")
def similarity_fill(spark, d):
    """Every other pair has its similarity; the rest get theirs from the vectors."""
    v = _vectors(spark, d)
    pairs = v.select(F.col("id").alias("rec"), (F.col("id") + 7).alias("s1"), F.when(F.col("id") % 2 == 0, F.lit(0.25)).alias("sim"))
    return blocking.fill_similarity(pairs, v, v).filter(F.col("sim").isNotNull()).join(v.select(F.col("id").alias("s1")), "s1", "left_semi").select("rec", "s1", "sim")


@query("""WITH n AS (SELECT o_custkey AS id, list_distinct(list(CAST(o_orderkey % 1000 AS VARCHAR))) AS nums FROM orders GROUP BY 1),
t AS (SELECT id, CAST('0x' || substr(md5(unnest(nums)), 1, 8) AS BIGINT) AS h FROM n),
p AS (SELECT id, h % 64 AS dim, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END) AS x FROM t GROUP BY ALL),
l AS (SELECT id, sqrt(sum(x * x)) AS norm FROM p GROUP BY id)
SELECT id, dim, round(0.45 * x / norm, 6) AS x FROM p JOIN l USING (id) WHERE x <> 0""")
def number_vectors(spark, d):
    """Signed hashes of numbers, their part of a record's vector."""
    o = model.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set((F.col("o_orderkey") % 1000).cast("string")).alias("nums"))
    none = F.array(F.lit(0.0))
    v = o.select("id", F.posexplode(F.slice(blocking.record_vector(none, none, blocking.number_vector(F.col("nums")), F.lit(False)), 3, 64)).alias("dim", "x"))
    return v.filter(F.col("x") != 0).select("id", F.col("dim").cast("long").alias("dim"), F.round("x", ROUND).alias("x"))


@query(f"WITH {_ASSIGNED}, kept AS (SELECT * FROM assigned WHERE p >= 0.7), {_COUNTS} SELECT s_nationkey AS country, count(*) AS n, round(avg({_F}), 6) AS macro_f05 FROM f JOIN supplier ON s_suppkey = s1 GROUP BY s_nationkey", pairs=True)
def macro_f05_by_country(spark, d):
    pairs = model.scored_pairs(spark, d)
    return decide.macro_f_by(_countries(spark, d), decide.by_threshold(decide.assign(pairs), 0.7), pairs.filter(F.col("y") == 1), "country")


def _countries(spark, d):
    return model.table(spark, d, "supplier").select(F.col("s_suppkey").alias("s1"), F.col("s_nationkey").alias("country"))


@query(f"""WITH {_ASSIGNED}, g AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5)) a(floor), (VALUES (0.0::DOUBLE), (0.1), (0.25)) b(extra)),
r AS (SELECT assigned.*, floor, extra, count(*) OVER u AS m, sum(p) OVER u AS c, sum(p) OVER s + extra AS t, exp(sum(ln(greatest(1 - p, 1e-9))) OVER s) AS none FROM assigned JOIN g ON p >= floor / 2
  WINDOW s AS (PARTITION BY floor, extra, s1), u AS (PARTITION BY floor, extra, s1 ORDER BY p DESC, src, rec ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, round(1.25 * c / (1.25 * c + 0.25 * (t - c) + (m - c)), 9) AS ef FROM r),
b AS (SELECT *, max(ef) OVER (PARTITION BY floor, extra, s1) AS best FROM e), z AS (SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY floor, extra, s1) AS most FROM b),
k AS (SELECT floor, extra, s1, count(*) AS np, sum(y) AS tp FROM z WHERE m <= most AND best > none AND p >= floor GROUP BY ALL), nt AS (SELECT s1, count(*) AS nt FROM pairs WHERE y = 1 GROUP BY s1),
f AS (SELECT g.floor, g.extra, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM g CROSS JOIN supplier LEFT JOIN k ON k.floor = g.floor AND k.extra = g.extra AND k.s1 = s_suppkey LEFT JOIN nt ON nt.s1 = s_suppkey)
SELECT floor, extra, round(avg({_F}), 6) AS macro_f05 FROM f GROUP BY floor, extra""", pairs=True)
def expected_f_grid(spark, d):
    pairs = model.scored_pairs(spark, d)
    return decide.tune_expected_f(_entities(spark, d), decide.assign(pairs), pairs.filter(F.col("y") == 1))


@query("SELECT s1, src, rec, round(CASE WHEN country % 5 = 0 THEN p - 0.1 ELSE p END, 6) AS p FROM pairs WHERE CASE WHEN country % 5 = 0 THEN p - 0.1 ELSE p END >= 0.8", pairs=True)
def threshold_shift(spark, d):
    """A threshold that is higher by 0.1 for unseen countries."""
    return decide.by_threshold(decide.shift_unseen(model.scored_pairs(spark, d), F.col("country") % 5 == 0, 0.1), 0.8).select("s1", "src", "rec", *_r("p"))


_CURVE = """ent AS (SELECT s_suppkey AS s1, s_nationkey AS country FROM supplier WHERE s_nationkey % 5 = 0), nc AS (SELECT country, count(*) AS n FROM ent GROUP BY country),
g AS (SELECT CAST(i AS DOUBLE) / 100 AS delta FROM generate_series(0, 29) t(i)),
hit AS (SELECT ent.country, delta, count(*) AS c FROM assigned a JOIN ent ON ent.s1 = a.s1 JOIN g ON p >= least(CASE src WHEN 2 THEN 0.6 WHEN 3 THEN 0.5 ELSE 0.99 END + delta, 0.995) GROUP BY ALL),
curve AS (SELECT nc.country, g.delta, round(coalesce(c, 0) / n, 6) AS mean_matches FROM nc CROSS JOIN g LEFT JOIN hit ON hit.country = nc.country AND hit.delta = g.delta)"""


def _curve(spark, d):
    unseen = _countries(spark, d).filter(F.col("country") % 5 == 0)
    return decide.curve_by_country(unseen, decide.assign(model.scored_pairs(spark, d)), {2: 0.6, 3: 0.5}, F.col("src"), [i / 100 for i in range(30)])


@query(f"WITH {_ASSIGNED}, {_CURVE} SELECT * FROM curve", pairs=True)
def calibration_by_country(spark, d):
    return _curve(spark, d)


@query(f"""WITH {_ASSIGNED}, {_CURVE}, tg AS (SELECT round(avg(mean_matches), 3) - 1 AS t FROM curve WHERE delta = 0),
m AS (SELECT *, CASE WHEN lag(mean_matches) OVER w - mean_matches > 5 THEN 1 ELSE 0 END AS fell, CASE WHEN mean_matches <= t THEN 1 ELSE 0 END AS met FROM curve, tg WINDOW w AS (PARTITION BY country ORDER BY delta)),
r AS (SELECT *, sum(fell) OVER u + sum(met) OVER u - met AS stop FROM m WINDOW u AS (PARTITION BY country ORDER BY delta ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY round(abs(mean_matches - t), 6), delta) AS k FROM r WHERE stop = 0 AND mean_matches >= t - 2)
SELECT max(delta) AS delta FROM k WHERE k = 1""", pairs=True)
def calibration_choice(spark, d):
    """One shift for all unseen countries, towards a mean of one match less than without it."""
    curve = _curve(spark, d)
    target = curve.filter(F.col("delta") == 0).agg(F.round(F.avg("mean_matches"), 3) - 1).first()[0]
    return decide.choose_delta(curve, target, slack=2, drop=5)


@query("""WITH o AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS x FROM pairs), q AS (SELECT *, x / (1 - x) / (1 + sum(x / (1 - x)) OVER (PARTITION BY src, rec)) AS share FROM o),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY round(share, 12) DESC, s1) AS k FROM q) WHERE k = 1), g AS (SELECT round(-0.3 + 0.005 * i, 3)::DOUBLE AS delta FROM generate_series(0, 179) t(i)),
c AS (SELECT delta, round(count(p) / (SELECT count(*) FROM supplier), 6) AS mean_matches FROM g LEFT JOIN a ON p >= least(CASE src WHEN 2 THEN 0.6 WHEN 3 THEN 0.5 ELSE 0.99 END + delta, 0.995) GROUP BY delta)
SELECT delta, mean_matches FROM c ORDER BY round(abs(mean_matches - 3.4), 6), delta LIMIT 1""", pairs=True)
def owner_choice(spark, d):
    """Owners by share, and the shift whose mean number of matches is nearest to a target."""
    pairs, ent = decide.renormalise(model.scored_pairs(spark, d)).withColumn("share", F.round("share", 12)), _entities(spark, d)
    deltas = [round(-0.3 + 0.005 * i, 3) for i in range(180)]
    curve = decide.curve_by_country(ent.withColumn("country", F.lit(0)), decide.assign(pairs, "share"), {2: 0.6, 3: 0.5}, F.col("src"), deltas)
    return decide.nearest_delta(curve, 3.4)


@query(f"""WITH {_ASSIGNED}, g AS (SELECT CAST(round(0.5 + 0.025 * i, 3) AS DOUBLE) AS t FROM generate_series(0, 18) x(i)), nt AS (SELECT s1, count(*) AS nt FROM pairs WHERE y = 1 GROUP BY s1),
c AS (SELECT s1, src, t, count(*) AS np, sum(y) AS tp FROM assigned JOIN g ON p >= t GROUP BY ALL),
f AS MATERIALIZED (SELECT a.t AS t2, b.t AS t3, round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1 WHEN np = 0 OR nt = 0 OR tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END), 6) AS f FROM (
  SELECT a.t AS ta, b.t AS tb, s_suppkey, coalesce(x.np, 0) + coalesce(z.np, 0) AS np, coalesce(x.tp, 0) + coalesce(z.tp, 0) AS tp, coalesce(nt, 0) AS nt
  FROM g a CROSS JOIN g b CROSS JOIN supplier LEFT JOIN c x ON x.src = 2 AND x.t = a.t AND x.s1 = s_suppkey LEFT JOIN c z ON z.src = 3 AND z.t = b.t AND z.s1 = s_suppkey LEFT JOIN nt ON nt.s1 = s_suppkey) q
  JOIN g a ON a.t = ta JOIN g b ON b.t = tb GROUP BY ALL),
s0 AS (SELECT t2, t3, f FROM f WHERE t2 = t3 ORDER BY f DESC, t2 DESC LIMIT 1),
s1 AS (SELECT * FROM (SELECT f.t2, f.t3, f.f FROM f, s0 WHERE f.t3 = s0.t3 AND f.f > s0.f + 1e-6 UNION ALL SELECT * FROM s0) ORDER BY f DESC, t2 LIMIT 1),
s2 AS (SELECT * FROM (SELECT f.t2, f.t3, f.f FROM f, s1 WHERE f.t2 = s1.t2 AND f.f > s1.f + 1e-6 UNION ALL SELECT * FROM s1) ORDER BY f DESC, t3 LIMIT 1),
s3 AS (SELECT * FROM (SELECT f.t2, f.t3, f.f FROM f, s2 WHERE f.t3 = s2.t3 AND f.f > s2.f + 1e-6 UNION ALL SELECT * FROM s2) ORDER BY f DESC, t2 LIMIT 1),
s4 AS (SELECT * FROM (SELECT f.t2, f.t3, f.f FROM f, s3 WHERE f.t2 = s3.t2 AND f.f > s3.f + 1e-6 UNION ALL SELECT * FROM s3) ORDER BY f DESC, t3 LIMIT 1)
SELECT CAST(2 AS INT) AS grp, t2 AS threshold, f AS macro_f05 FROM s4 UNION ALL SELECT 3, t3, f FROM s4""", pairs=True)
def group_tuning(spark, d):
    """Thresholds of record groups by coordinate ascent."""
    pairs = model.scored_pairs(spark, d)
    table, best = decide.tune_groups(_entities(spark, d), decide.assign(pairs), pairs.filter(F.col("y") == 1), "src", [2, 3])
    return spark.createDataFrame([(g, t, best) for g, t in sorted(table.items())], "grp int, threshold double, macro_f05 double")


@query()
def country_transfer(spark, d):
    """A blend learned on one country, measured on another, without and with pseudo-labels."""
    pairs = decide.blend_features(model.scored_pairs(spark, d)).withColumn("country", F.col("country") % 2).select("s1", "src", "rec", "country", "y", "la", "lb", "lab")
    rows = []
    for known, unseen in ((0, 1), (1, 0)):
        for form, r in learn.leave_country_out(pairs, ["la", "lb", "lab"], known, unseen, learn.fit_blend).items():
            rows.append((known, unseen, form, r["source_threshold"], r["at_source"], r["own_threshold"], r["own"]))
    return spark.createDataFrame(rows, "known int, unseen int, form string, source_threshold double, at_source double, own_threshold double, own double")


@query()
def second_normalisation(spark, d):
    """Cleaned words, numbers, and names without what is common in their country."""
    recs = words.second_form(model.records(spark, d).select("id", "country", "src", "name", "address"))
    recs = recs.withColumn("t", F.filter(words.tokens(F.col("name2")), lambda t: ~t.isin(*words.WEB)))
    out = stats.without(recs, "t", stats.common_tokens(recs.withColumn("t", words.tokens(F.col("name2"))), "t"))
    return out.select("id", "name2", "addr2", F.array_join("nums2", " ").alias("nums"), F.array_join("core", " ").alias("core"), F.array_join("core", "").alias("joined"))


def _part_pairs(spark, d):
    p = model.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("country"), F.lit(1).alias("src"), F.col("p_name").alias("name"), F.concat_ws(" ", F.col("p_size").cast("string"), "p_brand", "p_type").alias("address"))
    recs = text.normalise(p)
    for short, c in (("n", "name_core"), ("a", "addr_norm")):
        toks = recs.select("id", "country", "src", words.tokens(F.col(c)).alias("t"))
        lists = stats.idf_lists(toks, "t", stats.idf(toks, "t"), stats.sizes(toks))
        recs = recs.join(lists.withColumnRenamed("idfs", f"{short}_idf"), "id", "left")
    side = lambda s: recs.select(*(F.col(c).alias(f"{s}_{c}") for c in recs.columns))
    return side("a").join(side("b"), F.col("a_id") + 1 == F.col("b_id"))


@query()
def pair_features(spark, d):
    """Neighbouring parts as pairs: names, addresses, numbers, sounds."""
    out = pf.pair_features(_part_pairs(spark, d))
    return out.select("a_id", "b_id", *(F.round(c, 4).alias(c) for c, t in out.dtypes if t == "double"))


@query()
def noise_features(spark, d):
    """What tells a misprinted record from another entity, weighted overlaps, abbreviations, siblings."""
    out, nums = pf.weight_features(_part_pairs(spark, d)), lambda s: words.tokens(F.col(f"{s}_nums"))
    name = lambda s: words.tokens(F.col(f"{s}_name_core"))
    out = pf.anchor_similarity(out, "a_", "b_").select(
        "*", pf.number_noise(nums("a"), nums("b")).alias("noise"), pf.number_agreement(nums("b"), nums("a")).alias("agree"), pf.abbreviation_cover(name("b"), name("a")).alias("cover"),
        pf.joined_names(F.array_join(name("a"), ""), F.array_join(name("b"), "")).alias("joined"),
    )
    groups = {g: [f.name for f in out.schema[g].dataType] for g in ("n_over_a", "n_over_b", "a_over_a", "a_over_b", "n_aligned", "a_aligned", "noise", "agree", "cover", "joined")}
    flat = [F.round(F.col(f"{g}.{f}").cast("double"), 4).alias(f"{g}_{f}") for g, fs in groups.items() for f in fs]
    return out.select("a_id", "b_id", *(F.round(c, 4).alias(c) for c in ("unknown_b", "anc_ratio", "anc_set", "anc_addr", "anc_nums", "anc_first")), *flat)


@query("""WITH v AS (SELECT vec_id AS id, label AS block, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT id, block, e, sqrt(list_inner_product(e, e)) AS n FROM v)
SELECT rec, s1, sim, CAST(k - 1 AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY sim DESC, s1) AS k FROM (
  SELECT a.id AS rec, b.id AS s1, round(list_inner_product(a.e, b.e) / (a.n * b.n), 5) AS sim FROM u a JOIN u b ON a.block = b.block AND a.id % 3 <> 0 AND b.id % 3 = 0)) WHERE k <= CASE WHEN rec % 2 = 0 THEN 30 ELSE 10 END""")
def dense_nearest_deep(spark, d):
    """Thirty nearest for records without an address (here: even ids), ten for the rest."""
    v = _vectors(spark, d).withColumn("more", F.col("id") % 2 == 0)
    return blocking.nearest(v.filter(F.col("id") % 3 != 0), v.filter(F.col("id") % 3 == 0), k=10, k_more=30)


_CHANNELS = "ch AS (SELECT s1, src, rec, p AS sim, CASE WHEN q >= 0.3 THEN q END AS sp_score FROM pairs)"


@query(f"""WITH {_CHANNELS}, t AS (SELECT src, rec, list_sort(list(sim), 'DESC') AS a, list_sort(list(sp_score) FILTER (sp_score IS NOT NULL), 'DESC') AS b FROM ch GROUP BY ALL),
c AS (SELECT ch.*, a[1] AS q_best, a[2] AS q_second, b[1] AS q_sp_best, b[2] AS q_sp_second, max(sim) OVER s AS s1_best, max(sp_score) OVER s AS s1_sp_best, count(*) OVER s AS s1_ncand,
  row_number() OVER (PARTITION BY s1 ORDER BY sim DESC, src, rec) AS s1_rank FROM ch JOIN t USING (src, rec) WINDOW s AS (PARTITION BY s1))
SELECT s1, src, rec, round(q_best, 6) AS q_best, round(q_second, 6) AS q_second, round(q_sp_best, 6) AS q_sp_best, round(q_sp_second, 6) AS q_sp_second, round(s1_best, 6) AS s1_best, round(s1_sp_best, 6) AS s1_sp_best,
 s1_ncand, s1_rank, round(sim - q_best, 6) AS gap_q_best, round(q_best - coalesce(q_second, 0), 6) AS q_margin, round(sim - s1_best, 6) AS gap_s1_best, round(coalesce(sp_score, 0) - coalesce(q_sp_best, 0), 6) AS sp_gap_q,
 round(coalesce(q_sp_best, 0) - coalesce(q_sp_second, 0), 6) AS sp_margin, round(coalesce(sp_score, 0) - coalesce(s1_sp_best, 0), 6) AS sp_gap_s1 FROM c""", pairs=True)
def competition_block(spark, d):
    """All columns of the competition in two channels; the second lacks pairs below 0.3."""
    pairs = model.scored_pairs(spark, d).select("s1", "src", "rec", F.col("p").alias("sim"), F.when(F.col("q") >= 0.3, F.col("q")).alias("sp_score"))
    out = context.competition_block(pairs)
    tops = ("q_best", "q_second", "q_sp_best", "q_sp_second", "s1_best", "s1_sp_best")
    gaps = ("gap_q_best", "q_margin", "gap_s1_best", "sp_gap_q", "sp_margin", "sp_gap_s1")
    return out.select("s1", "src", "rec", *_r(*tops), "s1_ncand", F.col("s1_rank").cast("long").alias("s1_rank"), *_r(*gaps))


@query("""WITH t AS (SELECT src, rec, list_sort(list(p), 'DESC') AS a, list_sort(list(q), 'DESC') AS b, count(*) AS rec_ncand, sum(y) AS ex FROM pairs GROUP BY ALL),
o AS (SELECT s1, src, rec, p, q, rec_ncand, ex - y AS rec_exact_other, coalesce(CASE WHEN p >= a[1] THEN a[2] ELSE a[1] END, -1) AS po, coalesce(CASE WHEN q >= b[1] THEN b[2] ELSE b[1] END, -1) AS qo FROM pairs JOIN t USING (src, rec))
SELECT s1, src, rec, rec_ncand, CAST(rec_exact_other AS BIGINT) AS rec_exact_other, round(po, 6) AS p_other, round(CASE WHEN po < -0.5 THEN 99 ELSE p - po END, 6) AS p_gap,
 round(qo, 6) AS q_other, round(CASE WHEN qo < -0.5 THEN 99 ELSE q - qo END, 6) AS q_gap FROM o""", pairs=True)
def record_columns(spark, d):
    """Best other candidate and gap for several scores, candidates and exact ones (here: true pairs) of the record."""
    out = context.record_columns(model.scored_pairs(spark, d), ["p", "q"], F.col("y") == 1)
    return out.select("s1", "src", "rec", "rec_ncand", "rec_exact_other", *_r("p_other", "p_gap", "q_other", "q_gap"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, src, rec) AS k, sum(CAST(p > 0.8 AS INT)) OVER (PARTITION BY s1) AS sure FROM pairs),
t AS (SELECT s1, max(CASE WHEN k = 1 THEN p END) p1, max(CASE WHEN k = 2 THEN p END) p2, max(CASE WHEN k = 3 THEN p END) p3, max(CASE WHEN k = 1 THEN src END) s1_, max(CASE WHEN k = 2 THEN src END) s2_, max(CASE WHEN k = 3 THEN src END) s3_,
  max(CASE WHEN k = 1 THEN rec END) r1, max(CASE WHEN k = 2 THEN rec END) r2, max(CASE WHEN k = 3 THEN rec END) r3 FROM k WHERE k <= 3 GROUP BY s1),
a AS (SELECT k.s1, k.src, k.rec, k.p, sure, CASE WHEN k = 1 THEN p2 ELSE p1 END AS pa, CASE WHEN k = 1 THEN s2_ ELSE s1_ END AS sa, CASE WHEN k = 1 THEN r2 ELSE r1 END AS ra,
  CASE WHEN k <= 2 THEN p3 ELSE p2 END AS pb, CASE WHEN k <= 2 THEN s3_ ELSE s2_ END AS sb, CASE WHEN k <= 2 THEN r3 ELSE r2 END AS rb FROM k JOIN t ON t.s1 = k.s1)
SELECT s1, src, rec, CASE WHEN pa > 0.5 THEN sa END AS anc1_src, CASE WHEN pa > 0.5 THEN ra END AS anc1_rec, round(CASE WHEN pa > 0.5 THEN pa END, 6) AS anc1_p,
 CASE WHEN pb > 0.5 THEN sb END AS anc2_src, CASE WHEN pb > 0.5 THEN rb END AS anc2_rec, round(CASE WHEN pb > 0.5 THEN pb END, 6) AS anc2_p,
 CAST(coalesce(pa > 0.5, false) AS INT) AS has_anchor, CAST(coalesce(pb > 0.5, false) AS INT) AS has_second, CAST(sure - CAST(p > 0.8 AS INT) AS BIGINT) AS s1_cnt80_other FROM a""", pairs=True)
def family_anchors(spark, d):
    """First and second anchor of every pair, and its sure siblings."""
    out = context.family(model.scored_pairs(spark, d))
    return out.select("s1", "src", "rec", "anc1_src", "anc1_rec", *_r("anc1_p"), "anc2_src", "anc2_rec", *_r("anc2_p"), "has_anchor", "has_second", "s1_cnt80_other")


@query("SELECT id, (CASE WHEN src = 3 THEN 2 ELSE 0 END) + (CASE WHEN coalesce(address, '') = '' THEN 1 ELSE 0 END) AS grp FROM rec", recs=True)
def record_groups(spark, d):
    return model.records(spark, d).select("id", context.record_group(F.col("src"), F.col("address")).alias("grp"))


@query("""WITH x AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c, row_number() OVER (PARTITION BY src, rec ORDER BY p DESC, s1) - 1 AS rk_o, row_number() OVER (PARTITION BY s1, src ORDER BY p DESC, rec) - 1 AS rk_s FROM pairs),
w AS (SELECT *, max(p) OVER o AS t1o, coalesce(max(CASE WHEN rk_o = 1 THEN p END) OVER o, 0) AS t2o, max(p) OVER s AS t1s, coalesce(max(CASE WHEN rk_s = 1 THEN p END) OVER s, 0) AS t2s, count(*) OVER o AS n_o, count(*) OVER s AS n_s,
  count(*) FILTER (p > 0.5) OVER e AS cnt_hi_s, sum(p) OVER e AS sum_p_s, count(*) FILTER (p > 0.9) OVER s AS same9, count(*) FILTER (p > 0.9) OVER e AS all9, sum(p) OVER s AS sum_s FROM x
  WINDOW o AS (PARTITION BY src, rec), s AS (PARTITION BY s1, src), e AS (PARTITION BY s1))
SELECT s1, src, rec, round(ln(c / (1 - c)), 5) AS logit, rk_o, round(t1o - p, 6) AS gap_o, round(CASE WHEN rk_o = 0 THEN p - t2o ELSE p - t1o END, 6) AS mg_o, round(t2o, 6) AS top2_o, n_o, rk_s, round(t1s - p, 6) AS gap_s,
 round(CASE WHEN rk_s = 0 THEN p - t2s ELSE p - t1s END, 6) AS mg_s, n_s, cnt_hi_s, round(sum_p_s, 4) AS sum_p_s, CAST(src = 3 AS INT) AS src3, same9 - CAST(p > 0.9 AS INT) AS hi_same_other, all9 - same9 AS hi_cross, round(sum_s - p, 4) AS sum_same_other FROM w""", pairs=True)
def second_stack(spark, d):
    """The second pipeline's stack columns."""
    out = context.second_stack(model.scored_pairs(spark, d))
    whole = [F.col(c).cast("long").alias(c) for c in ("rk_o", "n_o", "rk_s", "n_s", "cnt_hi_s", "hi_same_other", "hi_cross")]
    return out.select("s1", "src", "rec", F.round("logit", 5).alias("logit"), *_r("gap_o", "mg_o", "top2_o", "gap_s", "mg_s"), *whole, "src3", *(F.round(c, 4).alias(c) for c in ("sum_p_s", "sum_same_other")))


@query("SELECT s1, src, rec, y, round(p, 6) AS p FROM pairs WHERE p > 0.002 AND p < 0.998", pairs=True)
def uncertain_band(spark, d):
    """Pairs that a further model has to look at."""
    return sampling.uncertain(model.scored_pairs(spark, d), 0.002, 0.998).select("s1", "src", "rec", "y", *_r("p"))


@query("""WITH h AS (SELECT *, CAST('0x' || substr(md5('class|' || rec || '|' || s1), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM pairs)
SELECT s1, src, rec, y FROM h WHERE (p > 0.3 AND p < 0.7) OR u < CASE WHEN y = 1 THEN 0.1 ELSE 0.002 END""", pairs=True)
def class_sampling(spark, d):
    """All uncertain pairs, a tenth of the sure true ones, two in a thousand of the sure wrong ones."""
    return sampling.by_class(model.scored_pairs(spark, d), low=0.3, high=0.7).select("s1", "src", "rec", "y")


@query("""WITH h AS (SELECT *, CAST('0x' || substr(md5('cap|' || rec || '|' || s1), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM pairs)
SELECT s1, src, rec, y FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u, rec, s1, src) AS k FROM h) WHERE k <= 500""", pairs=True)
def class_caps(spark, d):
    """Five hundred pairs of each class, a sample."""
    return sampling.per_class(model.scored_pairs(spark, d), 500).select("s1", "src", "rec", "y")


@query("""WITH h AS (SELECT id, length(address) AS n, CAST(floor(CAST('0x' || substr(md5('batch|' || id), 1, 8) AS BIGINT) / 4294967296.0 * 16) AS INT) AS shard FROM rec),
k AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n DESC, id) - 1 AS k FROM h) SELECT id, shard, CAST(k // 64 AS INT) AS batch, CAST(k % 64 AS INT) AS place FROM k""", recs=True)
def length_batches(spark, d):
    """Batches of texts of like length for a model."""
    recs = model.records(spark, d).select("id", "address")
    return sampling.length_batches(recs, F.col("address"), "id").select("id", "shard", "batch", "place")


@query("SELECT 'S1-' || s1 AS source1_entity_id, 'S' || src || '-' || rec AS candidate_entity_id, round(p, 6) AS score FROM pairs WHERE p > 0.02 AND NOT (q < 0.1)", pairs=True)
def score_export(spark, d):
    """Scores in the exchange form, of uncertain pairs that a cache does not hold (here: those with q below 0.1)."""
    pairs = model.scored_pairs(spark, d)
    return decide.exported(sampling.unscored(pairs.filter(F.col("p") > 0.02), pairs.filter(F.col("q") < 0.1))).withColumn("score", F.round("score", ROUND))


@query(f"""WITH {_ASSIGNED}, h AS (SELECT s1, src, rec, CAST('0x' || substr(md5('errors|' || rec || '|' || s1), 1, 8) AS BIGINT) / 4294967296.0 AS u, round(p, 6) AS p, y, p >= 0.7 AND EXISTS (SELECT 1 FROM assigned a WHERE a.s1 = pairs.s1 AND a.src = pairs.src AND a.rec = pairs.rec) AS kept FROM pairs),
k AS (SELECT *, row_number() OVER (PARTITION BY kept ORDER BY u, s1, src, rec) AS k FROM h WHERE kept <> (y = 1))
SELECT CASE WHEN kept THEN 'wrong' ELSE 'missed' END AS kind, s1, src, rec, p FROM k WHERE k <= 20""", pairs=True)
def error_sample(spark, d):
    """Twenty missed and twenty wrong pairs, a report."""
    pairs = model.scored_pairs(spark, d)
    return decide.error_sample(pairs, decide.by_threshold(decide.assign(pairs), 0.7), pairs.filter(F.col("y") == 1)).select("kind", "s1", "src", "rec", *_r("p"))


@query(f"""WITH g AS (SELECT CAST(round(0.5 + 0.025 * i, 3) AS DOUBLE) AS t FROM generate_series(0, 18) x(i)),
a1 AS (SELECT s1, src, rec, p AS v, y FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY p DESC, s1) AS k FROM pairs) WHERE k = 1), a2 AS (SELECT s1, src, rec, q AS v, y FROM (SELECT *, row_number() OVER (PARTITION BY src, rec ORDER BY q DESC, s1) AS k FROM pairs) WHERE k = 1),
nt AS (SELECT s1, count(*) AS nt FROM pairs WHERE y = 1 GROUP BY s1), c AS (SELECT sys, t, s1, count(*) AS np, sum(y) AS tp FROM (SELECT 1 AS sys, * FROM a1 UNION ALL SELECT 2, * FROM a2) JOIN g ON v >= t GROUP BY ALL),
e AS (SELECT z.sys, g.t, s_suppkey % 2 AS fold, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM (VALUES (1), (2)) z(sys) CROSS JOIN g CROSS JOIN supplier LEFT JOIN c ON c.sys = z.sys AND c.t = g.t AND c.s1 = s_suppkey LEFT JOIN nt ON nt.s1 = s_suppkey),
f AS (SELECT sys, t, fold, {_F} AS f FROM e), b AS (SELECT sys, t FROM (SELECT *, row_number() OVER (PARTITION BY sys ORDER BY m DESC, t DESC) AS k FROM (SELECT sys, t, round(avg(f), 6) AS m FROM f GROUP BY ALL)) WHERE k = 1),
r AS (SELECT sys, fold, any_value(t) AS t, round(avg(f), 6) AS m FROM f JOIN b USING (sys, t) GROUP BY ALL), j AS (SELECT a.fold, a.t AS one_threshold, a.m AS one_f, z.t AS two_threshold, z.m AS two_f FROM r a JOIN r z USING (fold) WHERE a.sys = 1 AND z.sys = 2)
SELECT *, min(CAST(two_f > one_f AS INT)) OVER () AS use FROM j""", pairs=True)
def stack_choice(spark, d):
    """Whether a second system is better on both folds (here: odd and even entities)."""
    pairs = model.scored_pairs(spark, d)
    ent = _entities(spark, d).withColumn("fold", F.col("s1") % 2)
    return decide.better_on_folds(ent, pairs, pairs.filter(F.col("y") == 1))


@query(f"""WITH {_TOKENS}, {_OVERLAP}, tr AS (SELECT r.src, r.id AS rec, l.id AS s1, CASE WHEN regexp_matches(r.name, '^[\\x00-\\x7F]*$') THEN 'ascii' ELSE 'other' END AS script FROM rec l JOIN rec r ON l.country = r.country AND l.name = r.name AND l.address = r.address AND l.src = 1 AND r.src <> 1),
h AS (SELECT tr.*, coalesce(sp_rank, 1073741824) AS k FROM tr LEFT JOIN ov USING (src, rec, s1))
SELECT script, count(*) AS n, round(avg(CAST(k < 1 AS INT)), 6) AS recall_1, round(avg(CAST(k < 3 AS INT)), 6) AS recall_3, round(avg(CAST(k < 5 AS INT)), 6) AS recall_5, round(avg(CAST(k < 10 AS INT)), 6) AS recall_10
FROM h GROUP BY GROUPING SETS ((), (script))""", recs=True)
def recall_by_script(spark, d):
    """The recall gate by the script of the noisy record's name."""
    recs = model.records(spark, d)
    key = F.sha2(F.concat_ws("\x01", "name", "address"), 256)
    script = F.when(F.col("name").rlike("^[\\x00-\\x7F]*$"), F.lit("ascii")).otherwise(F.lit("other"))
    left = recs.filter(F.col("src") == 1).select("country", key.alias("key"), F.col("id").alias("s1"))
    truth = recs.filter(F.col("src") != 1).select("country", key.alias("key"), "src", F.col("id").alias("rec"), script.alias("script")).join(left, ["country", "key"]).select("src", "rec", "s1", "script")
    return blocking.recall_gate(blocking_overlap(spark, d), truth, slices=("script",))


@query("""WITH a AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS x, string_split(lower(p_type), ' ') AS y, p_size AS s FROM part), n AS (SELECT *, [CAST(s AS VARCHAR)] AS m, [CAST(p_partkey % 100 AS VARCHAR)] AS k FROM a)
SELECT p_partkey, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jac, len(list_intersect(x, y)) AS shared, abs(len(list_distinct(x)) - len(list_distinct(y))) AS size_gap,
 CAST(m[1] = k[1] AS INT) AS same, CAST(length(m[1]) = length(k[1]) AND m[1] <> k[1] AS INT) AS differs, CAST(m[1] <> k[1] AND (starts_with(m[1], k[1]) OR starts_with(k[1], m[1])) AS INT) AS prefix, CAST(m[1] <> k[1] AND (ends_with(m[1], k[1]) OR ends_with(k[1], m[1])) AS INT) AS suffix,
 round(ln(1 + abs(CAST(m[1] AS BIGINT) - CAST(k[1] AS BIGINT))), 6) AS log_gap, levenshtein(m[1], k[1]) AS edits FROM n""")
def set_and_number_pairs(spark, d):
    """The native columns of pair features: token sets, and signs that tell a misprinted number."""
    one = lambda c: F.array(c.cast("string"))
    a = model.table(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("x"), F.split(F.lower("p_type"), " ").alias("y"), one(F.col("p_size")).alias("m"), one(F.col("p_partkey") % 100).alias("k"))
    out = a.select("*", pf.number_noise(F.col("m"), F.col("k")).alias("n"))
    size = lambda c: F.size(F.array_distinct(c))
    whole = {"shared": F.size(F.array_intersect("x", "y")), "size_gap": F.abs(size("x") - size("y")), "same": (F.col("m") == F.col("k")).cast("int"), "differs": F.col("n.same_length_differs"), "prefix": F.col("n.prefix"), "suffix": F.col("n.suffix"), "edits": F.col("n.min_edits")}
    return out.select("p_partkey", F.round(sim.jaccard(F.col("x"), F.col("y")), ROUND).alias("jac"), F.round("n.log_gap", ROUND).alias("log_gap"), *(v.cast("long").alias(c) for c, v in whole.items()))
