"""Linkage operators that SQL does not express, against brute force on small tables, and their edge cases."""

import itertools
import random

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinlink.functions import pairs, words
from kinlink.operators import blocking, context, decide, learn, sampling, stats
from kinlink.plans import queries


def test_second_normalisation(spark):
    rows = ["कमल & de1hi 5ervice's <NULL> É", "दिल्ली", None, "", "hdfc 24x7 1st", "a1b 0x3c h0150w 1abc 9abc ab0", "ಕನ್ನಡ ೧೨", "মানুষ ৎ"]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(words.clean(F.col("t")).alias("c")).collect()]
    assert got[0] == "kamal and delhi services e" and got[1] == "dilli" and got[2] == got[3] == "" and got[4] == "hdfc 24x7 1st"
    assert got[5] == "alb oxec holsow labc 9abc ab0" and got[6] == "kannad 12" and got[7] == "manush t"
    rec = spark.createDataFrame([(1, "Foo 12345678 Bar", "No 007, 0, Main"), (2, None, None)], "id int, name string, address string")
    got = {r["id"]: (r["name2"], r["nums2"], r["words2"]) for r in words.second_form(rec).collect()}
    assert got == {1: ("foo bar", ["7"], ["no", "main"]), 2: ("", [], [])}


def test_crossed_tokens(spark):
    row = spark.range(1).select(words.crossed(F.lit(["foo", "b", "bar"]), F.lit(["road"]), F.lit(["7"])).alias("t"), words.core_tokens(F.lit(["www", "ltd"]), F.lit(["ltd"])).alias("c")).first()
    assert sorted(row["t"]) == sorted(["n:foo", "n:bar", "a:road", "d:7", "j:foobbar", "x:7_road", "y:foo_7", "y:bar_7", "c:foo_road", "c:bar_road"])
    assert row["c"] == ["ltd"]


def test_abbreviations_and_alignment(spark):
    rows = [(["bldg", "a"], ["building", "a", "a"]), ([], ["a"]), (["st"], ["street", "st"]), (["x", "y"], ["z"]), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<string>, b array<string>")
    got = [tuple(r["c"]) for r in df.orderBy("i").select(pairs.abbreviation_cover(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [(1.0, 2 / 3, 1, 1), (0.0, 0.0, 0, 0), (1.0, 0.5, 0, 1), (0.0, 0.0, 0, 0), (0.0, 0.0, 0, 0)]
    words = spark.createDataFrame([("bldg", "building"), ("bx", "building"), ("", "a"), ("a", "a"), ("building", "bldg")], "x string, y string")
    assert [r[0] for r in words.select(pairs.shortens(F.col("x"), F.col("y"))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(["martha", "x"], ["marhta", "other"], [1.0, 2.0], [3.0, 4.0]), ([], [], [], [])], "a array<string>, b array<string>, wa array<double>, wb array<double>")
    got = [tuple(r["c"]) for r in df.select(pairs.align(*map(F.col, ("a", "b", "wa", "wb"))).alias("c")).collect()]
    assert got == [(1, 1, 2, 4.0, 4.0, 1.0), (0, 0, 0, -1.0, -1.0, -1.0)]


def test_projection_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((40, 25)) < 0.3) * rng.random((40, 25))
    table = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "id int, f int, w double")
    got = np.array([r["vec"] for r in learn.project(table, k=3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = (u * s)[:, :3][x.any(axis=1)]
    assert np.allclose(np.abs((got * want).sum(axis=0)), (want**2).sum(axis=0), rtol=5e-3)


def test_ngrams_and_weights(spark):
    df = spark.createDataFrame([(1, "ab a"), (2, ""), (3, None), (4, "ab")], "id int, t string")
    got = {(r["id"], r["gram"]): r["tf"] for r in learn.ngrams(df, "t").collect()}
    assert got == {(i, g): 1 for i in (1, 4) for g in (" a", "ab", "b ", " ab", "ab ", " ab ")} | {(1, " a"): 2, (1, "a "): 1, (1, " a "): 1}
    norms = {r["id"]: r["n"] for r in learn.tfidf(df, "t").groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n")).collect()}
    assert set(norms) == {1, 4} and all(abs(n - 1) < 1e-9 for n in norms.values())


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=3000).round(1), "b": np.array([2.5]), "c": np.repeat([1.0, 7.0], [900, 100]), "d": np.arange(7.0)}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("e", None)], "g string, x double")
    for knots in (3, 201):
        got = {r["g"]: r["knots"] for r in stats.quantiles(df, "g", "x", knots).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            assert np.allclose(got[g], np.quantile(x, np.linspace(0, 1, knots)), atol=1e-9)


def test_fillers_move(spark):
    df = spark.createDataFrame([(1, "x", ["a", "f", "a"]), (2, "x", ["f"]), (3, "y", ["f", "b"]), (4, None, ["f"])], "id int, country string, t array<string>")
    known = spark.createDataFrame([("x", "f"), ("x", "f"), ("z", "b")], "country string, tok string")
    got = {r["id"]: (r["core"], r["moved"]) for r in stats.without(df, "t", known).collect()}
    assert got == {1: (["a", "a"], ["f"]), 2: (["f"], []), 3: (["f", "b"], []), 4: (["f"], [])}


def test_numbers(spark):
    none = F.array().cast("array<string>")
    row = spark.range(1).select(pairs.number_noise(F.lit(["123"]), F.lit(["124", "9"])).alias("n"), pairs.number_noise(none, F.lit(["1"])).alias("e"), pairs.number_agreement(F.lit(["12"]), F.lit(["123"])).alias("a"), pairs.number_agreement(none, none).alias("z")).first()
    assert tuple(row["n"]) == (1.0, 0.0, 0.0, float(np.log1p(1)), 1.0, 1.0, 2.0) and set(row["e"]) == {-1.0}
    assert tuple(row["a"])[:9] == (1, 1, 0, 0.0, 0, 1, 1, 0, 0) and tuple(row["z"]) == (0, 0, 0, 0.0, 0, 9, 0, 0, 0, -1.0)


def test_pair_features_take_nulls(spark):
    cols = [f"{s}_{c}" for s in "ab" for c in "name_core name_legal addr_norm nums state ph acr name address".split()]
    df = spark.createDataFrame([tuple([None] * len(cols)), tuple(["foo 12"] * len(cols))], ", ".join(f"{c} string" for c in cols))
    out = [r.asDict() for r in pairs.pair_features(df).collect()]
    assert all(r["name_ratio"] == 100.0 for r in out) and {r["addr_equal"] for r in out} == {-1.0, 1.0}


def test_nearest_in_parts(spark):
    rng = np.random.default_rng(4)
    vecs = [(i, "b" if i < 90 else "c", v.tolist()) for i, v in enumerate(rng.normal(size=(100, 5)).round(1))]
    vecs[7] = (7, "b", vecs[3][2])
    df = spark.createDataFrame([*vecs, (200, None, [0.0] * 5), (201, "b", None)], "id long, block string, vec array<double>")
    got = {}
    for r in blocking.nearest(df.filter("id % 2 = 1"), df.filter("id % 2 = 0"), k=3, chunk=16).collect():
        got.setdefault(r["rec"], []).append((r["rank"], r["s1"]))
    for i, b, v in vecs:
        if i % 2:
            best = sorted((-round(float(np.dot(v, w)), 5), j) for j, c, w in vecs if c == b and j % 2 == 0)[:3]
            assert [j for _, j in sorted(got[i])] == [j for _, j in best]
    assert blocking.nearest(df.filter("id < 0"), df).count() == 0


def scored(spark, seed=2, n=60):
    rng = random.Random(seed)
    rows = [(s, src, r, s % 2, round(rng.random(), 2), int(rng.random() < 0.4)) for s in range(8) for src in (2, 3) for r in rng.sample(range(20), n // 12)]
    return spark.createDataFrame(rows, "s1 int, src int, rec int, country int, p double, y int"), spark.createDataFrame([(s,) for s in range(10)], "s1 int")


def brute_f(rows, table, truth):
    total = 0
    for s in range(10):
        kept = {(r.src, r.rec) for r in rows if r.s1 == s and r.p >= table[r.src]}
        true = {(r.src, r.rec) for r in truth if r.s1 == s}
        tp = len(kept & true)
        if not kept or not true or not tp:
            total += not kept and not true
        else:
            p, q = tp / len(kept), tp / len(true)
            total += 1.25 * p * q / (0.25 * p + q)
    return round(total / 10, 6)


def test_group_tuning_against_brute_force(spark):
    df, ent = scored(spark)
    assigned, truth = decide.assign(df), df.filter("y = 1")
    rows, true, grid = assigned.collect(), truth.collect(), (0.5, 0.7, 0.9)
    best, start = max((brute_f(rows, {2: t, 3: t}, true), t) for t in grid)
    table = {2: start, 3: start}
    for _, g, t in itertools.product(range(2), (2, 3), grid):
        f = brute_f(rows, {**table, g: t}, true)
        if f > best + 1e-6:
            best, table = f, {**table, g: t}
    got, f = decide.tune_groups(ent, assigned, truth, "src", [2, 3], grid)
    assert (got, f) == (table, best)


def test_choice_of_shift(spark):
    curve = spark.createDataFrame([(c, d, m) for c, ms in (("a", (3.5, 3.45, 3.38, 3.3)), ("b", (3.6, 3.44, 2.0, 1.9)), ("c", (3.4, 3.2, 3.41, 3.4))) for d, m in enumerate(ms)], "country string, delta int, mean_matches double")
    assert decide.choose_delta(curve.filter("country = 'a'"), 3.4).first()["delta"] == 2
    assert decide.choose_delta(curve.filter("country = 'b'"), 3.4).first()["delta"] == 0
    assert decide.choose_delta(curve.filter("country = 'c'"), 3.4).first()["delta"] == 0
    assert decide.choose_delta(curve, 3.4).first()["delta"] == 2
    assert tuple(decide.nearest_delta(curve.filter("country = 'a'"), 3.4).first()) == (2, 3.38)


def test_transfer_rule():
    r = lambda a, b, own, at, t: {"plain": {"source_threshold": 0.6, "at_source": a, "own_threshold": t, "own": own}, "self_train": {"source_threshold": 0.6, "at_source": b, "own_threshold": at, "own": own}}
    train, shift = learn.transfer_rule([r(0.8, 0.9, 0.95, 0.7, 0.6), r(0.8, 0.85, 0.9, 0.65, 0.6)])
    assert train and abs(shift - 0.075) < 1e-9
    assert learn.transfer_rule([r(0.8, 0.7, 0.9, 0.7, 0.5), r(0.8, 0.85, 0.9, 0.65, 0.7)]) == (False, 0.0)


def test_fill_keeps_what_is_there(spark):
    p = spark.createDataFrame([(1, 2, None), (1, 3, 0.5), (1, 9, None)], "rec int, s1 int, sim double")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [1.0, 1.0])], "id int, vec array<double>")
    assert {tuple(r) for r in blocking.fill_similarity(p, v, v).collect()} == {(1, 2, 0.5), (1, 3, 0.5), (1, 9, None)}


def test_family_against_brute_force(spark):
    df, _ = scored(spark, seed=5)
    rows = df.collect()
    for r in context.family(df).collect():
        others = sorted((-x.p, x.src, x.rec) for x in rows if x.s1 == r.s1 and (x.src, x.rec) != (r.src, r.rec) and x.p > 0.5)[:2]
        got = [(-r[f"{a}_p"], r[f"{a}_src"], r[f"{a}_rec"]) for a in ("anc1", "anc2") if r[f"{a}_rec"] is not None]
        assert got == others and (r.has_anchor, r.has_second) == (len(others) > 0, len(others) > 1)
        assert r.s1_cnt80_other == sum(x.p > 0.8 for x in rows if x.s1 == r.s1) - (r.p > 0.8)


def test_rules_and_folds(spark):
    assert decide.choose_rule({"one": {"a": 0.5, "b": 0.6}, "two": {"a": 0.6, "b": 0.4}}) == ("two", "a")
    assert decide.choose_rule({"one": {"a": 0.7}, "two": {"a": 0.6}}) == ("one", "a")
    df, ent = scored(spark, seed=9)
    df = df.withColumn("q", F.when(F.col("y") == 1, F.lit(0.95)).otherwise(F.lit(0.2)))
    got = decide.better_on_folds(ent.withColumn("fold", F.col("s1") % 2), df, df.filter("y = 1")).collect()
    assert len(got) == 2 and {r["use"] for r in got} == {int(all(r["two_f"] > r["one_f"] for r in got))}
    sample = decide.error_sample(df, decide.by_threshold(decide.assign(df), 0.5), df.filter("y = 1"), n=3).collect()
    assert 0 < len(sample) <= 6 and {r["kind"] for r in sample} <= {"missed", "wrong"}


def test_batches_and_caps(spark):
    df = spark.range(100).select(F.col("id"), F.expr("repeat('x', cast(id % 17 as int))").alias("t"))
    rows = sampling.length_batches(df, F.col("t"), "id", size=4, shards=3).collect()
    assert len(rows) == 100 and max(r["place"] for r in rows) == 3
    for s in range(3):
        own = sorted((r["batch"], r["place"], len(r["t"])) for r in rows if r["shard"] == s)
        assert [x[2] for x in own] == sorted((x[2] for x in own), reverse=True)
    pairs_, _ = scored(spark)
    capped = sampling.per_class(pairs_, 5).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in capped} == {0: 5, 1: 5}
    cache = pairs_.filter("p > 0.5")
    assert sampling.unscored(pairs_, cache).count() == pairs_.filter("p <= 0.5").count()


def test_nearest_with_more_for_some(spark):
    vecs = spark.createDataFrame([(i, "b", [float(i), 1.0], i % 2 == 0) for i in range(12)], "id long, block string, vec array<double>, more boolean")
    got = blocking.nearest(vecs, vecs.drop("more"), k=2, k_more=5).groupBy("rec").count().collect()
    assert {r["rec"]: r["count"] for r in got} == {i: 5 if i % 2 == 0 else 2 for i in range(12)}


def test_sources_and_parts(spark):
    from kinlink.sources import tsv

    recs = spark.createDataFrame([(f"S{s}-{i}", s) for s in (1, 2) for i in range(40)], "id string, src int")
    truth = spark.createDataFrame([(f"S1-{i}", f"S2-{i}") for i in range(20)], "s1 string, rec string")
    some = {r["id"] for r in tsv.sample(recs, truth, 0.5).collect()}
    for i in range(20):
        assert (f"S1-{i}" in some) == (f"S2-{i}" in some)
    assert 10 < len(some) < 70
    assert tsv.records_of(recs, spark.createDataFrame([("S1-3",), ("S1-3",)], "id string")).count() == 1
    a, b = (spark.createDataFrame(x, "s1 int, src int, rec int") for x in ([(1, 2, 3), (1, 2, 4)], [(1, 2, 3)]))
    assert [r["rec"] for r in tsv.missing_candidates(a, b).collect()] == [4]
    v = spark.range(1).select(blocking.part_of(F.lit([9.0, 3.0, 4.0]), 2, 2).alias("v")).first()["v"]
    assert np.allclose(v, [0.6, 0.8])
    assert [r[0] for r in sampling.shuffled(spark.range(5), "s", "id").collect()] != [0, 1, 2, 3, 4]


def test_gram_weights_never_broadcast_the_grams(spark, monkeypatch):
    """whatever sizes Spark estimates, only a counted vocabulary is broadcast; both joins give the same weights."""
    df = spark.createDataFrame([(1, "old ring"), (2, "old ring"), (3, "a"), (3, "old"), (4, None), (5, "")], "id int, t string")
    rounded = lambda d: sorted((r["id"], r["grams"], round(r["weight"], 9)) for r in d.collect())
    grams = [r.asDict() for r in learn.ngrams(df, "t").collect()]
    seen = {g: sum(r["gram"] == g for r in grams) for g in {r["gram"] for r in grams}}
    want = {i: [np.log1p(r["tf"]) * (np.log(7 / (seen[r["gram"]] + 1)) + 1) for r in grams if r["id"] == i] for i in (1, 2, 3)}
    want = sorted((i, len(w), round(float(sum(w)), 9)) for i, w in want.items())
    few = learn.gram_weights(df, "t")
    assert rounded(few) == want
    monkeypatch.setattr(learn, "MOST_GRAMS", 0)
    many = learn.gram_weights(df, "t")
    assert rounded(many) == want
    assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString()


def test_products_by_turns_and_blocks(spark, monkeypatch):
    """F2 to F8: several turns and blocks give what one gives and what brute force gives; no table of token pairs is made."""
    from kinlink.operators import products

    rng = random.Random(5)
    rows = sorted({(i, "ab"[i % 2], i % 3 + 1, f"t{rng.randrange(40)}") for i in range(60) for _ in range(8)})
    toks = spark.createDataFrame(rows + rows[:5], "id long, country string, src int, tok string")
    n = blocking.block_sizes(toks)
    monkeypatch.setattr(products, "SMALL", 0)
    monkeypatch.setattr(products, "ROUNDS", 2)
    monkeypatch.setattr(products, "CLEAN", 40)
    monkeypatch.setattr(products, "NOISY", 30)
    monkeypatch.setattr(products, "SUMS", 32)
    got = {(r["src"], r["rec"], r["sp_rank"]): (r["s1"], r["sp_score"]) for r in blocking.overlap(toks, n, cap=6, k=3).collect()}
    want = {}
    for c in "ab":
        have = {}
        for i, country, src, t in rows:
            if country == c:
                have.setdefault((src, i), set()).add(t)
        clean = {i: t for (src, i), t in have.items() if src == 1}
        df = {t: sum(t in x for x in clean.values()) for x in have.values() for t in x}
        for (src, i), mine in have.items():
            shared = {s1: {t for t in mine & x if df[t] <= 6} for s1, x in clean.items()} if src != 1 else {}
            best = sorted((-round(sum(np.log(len(clean) / df[t]) for t in ts), 6), s1) for s1, ts in shared.items() if ts)[:3]
            want |= {(src, i, k): (s1, -score) for k, (score, s1) in enumerate(best)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_augmented_names_of_any_letters(spark, tmp_path):
    """Initials that are ligatures or have no single capital, İ and a Σ at the end of a word: the same rows as the SQL."""
    heads = ["ßtadt ßen", "ﬁne ǰoke", "ᾳ ŉ ᾈ", "İstanbul ΟΔΟΣ", "ΑΣ Σ", "ɤ ƛ", "étoile d'ñ"]
    docs = pd.DataFrame([(i, f"{heads[i % 7]}\nrest ΣΑΣ", "en", "src1", 9) for i in range(700)], columns="doc_id text lang source n_chars".split())
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    theirs = con.sql(queries.SQL["augmented_names"]).fetchall()
    ours = queries.QUERIES["augmented_names"](spark, str(tmp_path)).select("id", "name", "noisy").collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)


def test_tokens_go_by_turns(spark, monkeypatch):
    """F3 to F7: tokens are deleted turn by turn, both channels take one count of them, and the rows are those of each alone."""
    import pathlib

    from kinlink.operators import products

    rng = random.Random(6)
    rows = [(i, "ab"[i % 2], i % 3 + 1, ["".join(rng.choices("abcd", k=3)) for _ in range(2)], ["".join(rng.choices("abc", k=3)) for _ in range(6)]) for i in range(90)]
    records = spark.createDataFrame(rows, "id long, country string, src int, name_toks array<string>, addr_toks array<string>")
    toks = blocking.token_families(records)
    n = blocking.block_sizes(toks)
    table = lambda df: sorted(tuple(r) for r in df.collect())
    alone = table(blocking.cosine(toks, n, cap=9)), table(blocking.overlap(toks, n, cap=5))
    folder = pathlib.Path(toks.inputFiles()[0].removeprefix("file://")).parent.parent
    assert len(list(folder.glob("turn=*/*.parquet"))) > 1
    monkeypatch.setattr(products, "SMALL", 0)
    left = []
    monkeypatch.setattr(products, "remove", lambda s, path, f=products.remove: (f(s, path), left.append(len(list(folder.glob("turn=*")))))[0])
    dense, sparse = blocking.both_channels(toks, n, cap=9, overlap_cap=5, last=True)
    assert (table(dense), table(sparse)) == alone
    assert left[0] > left[-1] == 0 and left == sorted(left, reverse=True)


def test_packed_tokens_against_sql(spark, tmp_path, monkeypatch):
    """records in many small blocks, repeated ids, words over 64 letters, null texts: rows of the SQL; the table has a row for a block and turn, not for a token."""
    from kinlink import model
    from kinlink.operators import products

    rng = random.Random(8)
    words_ = ["".join(rng.choices("abchkx1é", k=rng.randrange(1, 7))) for _ in range(60)] + ["a" * 64 + "b" * 9, "b" * 64 + "a" * 9, "a" * 70]
    text = lambda: " ".join(rng.choices(words_, k=rng.randrange(4))) + "\n" + " ".join(rng.choices(words_, k=rng.randrange(25)))
    docs = [(i, None if i % 31 == 0 else text(), ("en", "de", None)[i % 7 % 3], f"src{i % 4}", 9) for i in range(150)]
    docs += [(i, text(), *docs[i][2:]) for i in range(0, 150, 4)]  # other texts of the same ids
    pd.DataFrame(docs, columns="doc_id text lang source n_chars".split()).to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(products, "BLOCK", 300)
    monkeypatch.setattr(products, "SMALL", 0)
    monkeypatch.setattr(products, "CLEAN", 700)
    monkeypatch.setattr(products, "FEW", 50)
    with products.setting(spark, "spark.sql.files.maxPartitionBytes", "2k"):
        toks = blocking.token_families(model.records(spark, str(tmp_path)))
        assert toks.count() < 400
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
        for name in ("blocking_cosine", "blocking_overlap", "pair_cosine"):
            ours = queries.QUERIES[name](spark, str(tmp_path))
            theirs = con.sql(queries.SQL[name]).df()[ours.columns].sort_values(["src", "rec", "s1"]).to_numpy(dtype=float)
            assert len(theirs) > 100 and np.allclose(ours.toPandas().sort_values(["src", "rec", "s1"]).to_numpy(dtype=float), theirs, rtol=0, atol=2e-6)


def test_pair_cosine_counts_tokens_once(spark, monkeypatch):
    """the overlap and the cosine of its pairs take one count of the tokens."""
    made = []
    monkeypatch.setattr(blocking, "vectors", lambda *a, f=blocking.vectors: (made.append(a), f(*a))[1])
    records = spark.createDataFrame([(i, "a", i % 3 + 1, ["ab", "cd"][: i % 3], ["x", str(i % 5)]) for i in range(30)], "id long, country string, src int, name_toks array<string>, addr_toks array<string>")
    toks = blocking.token_families(records)
    assert blocking.overlap_cosine(toks, blocking.block_sizes(toks), last=True).count() > 0 and len(made) == 1
