"""The five stages over the smallest tables."""

import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r[0]: r for r in docs.collect()}
    kept = set(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len({r[0] for r in rows}) == len(rows) and {r[0] for r in rows} <= kept
        kept = {r[0] for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    assert len(kept) > 0.6 * len(before)
    mixed = corpus_pipeline.mixture(spark, docs, SF)
    rows = mixed.collect()
    assert mixed.columns[: len(docs.columns)] == docs.columns and {r["doc_id"] for r in rows} <= kept and all(r["copies"] > 0 and r["text"] for r in rows)


def test_stages_take_empty_tables_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, size string"
    odd = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, "word " * 30_000, "en", None, 150_000, None, None)]
    for rows in ([], odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(rows, schema), SF)
            assert out.count() <= len(rows), name
            assert name == "mixing" or out.columns == [x.split()[0] for x in schema.split(", ")]


def test_null_ids_pass_near_dedup(spark):
    text = lambda p, n=120: " ".join(f"{p}{i}" for i in range(n))
    near = text("b").replace("b60 ", "changed ")
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (None, near), (None, text("c")), (2, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]
    assert len(got) == 4 and {(1, text("a")), (2, text("d")), (None, text("c"))} <= set(got)
    assert len({(None, text("b")), (None, near)} & set(got)) == 1


def small_corpus(rng):
    """Documents of prose, junk, copies, near copies, shared passages and benchmark items; labels; benchmark."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(20))) for i in range(4)]
    passage, texts, good = prose(40), [], []
    for i in range(70):
        w = prose(rng.randint(60, 160))
        if i % 7 == 0:
            w[30:30] = passage
        if i % 11 == 5:
            w[20:20] = items[i % 4][1].split()
        if i % 5 == 4:
            w = [x + rng.choice(("$$$", "%%%", "***")) for x in w]
        texts.append(" ".join(w))
        good.append(int(i % 5 != 4))
    for i in range(20):
        w = texts[i].split()
        if i % 2:
            w[len(w) // 2] = "changed"
        texts.append(" ".join(w)), good.append(good[i])
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    return docs, [(i, y, 0) for i, y in enumerate(good)], items


def test_stages_against_brute_force(spark, tmp_path):
    import random

    from test_operators import brute_distance, brute_probability, brute_substrings, brute_targets, jaccard

    from kinlink.llm import decontamination, quality, substring_dedup

    docs, labels, items = small_corpus(random.Random(21))
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = {r[0]: r[1] for r in docs}
    source = {r[0]: r[3] for r in docs}

    def after(name):
        rows = stages[name](spark, spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in sorted(now.items())], schema), sf).collect()
        assert len({r["doc_id"] for r in rows}) == len(rows)
        return rows

    net = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["text"] for r in after("quality")}
    assert got == {i: t for i, t in now.items() if brute_probability(net, t) >= 0.5} and 50 < len(got) < 85
    now = got

    got = {r["doc_id"]: r["text"] for r in after("near_dedup")}
    first = {i: i for i in now}
    for _ in range(3):
        for i in now:
            for j in now:
                if j < i and (now[i] == now[j] or jaccard(now[i], now[j]) >= 0.8):
                    first[i] = first[j] = min(first[i], first[j])
    assert got == {i: t for i, t in now.items() if first[i] == i} and len(got) < len(now) - 10
    now = got

    got = {r["doc_id"]: r["text"] for r in after("substring_dedup")}
    want = brute_substrings(list(now.items()))
    for i, t in now.items():
        n, removed, digest = want[i]
        left = got.get(i, "").split()
        assert len(left) == n - removed and __import__("hashlib").sha256(" ".join(left).encode()).hexdigest() == digest
    assert any(x[1] >= 40 for x in want.values()) and substring_dedup.WINDOW == 13
    now = got

    got = {r["doc_id"]: r["text"] for r in after("decontamination")}
    leaks = {i for i, t in now.items() for _, x in items if brute_distance(x.split(), decontamination.normal_words(t)) <= decontamination.allowed(20)}
    assert got == {i: t for i, t in now.items() if i not in leaks} and leaks
    now = got

    rows = after("mixing")
    names = sorted({source[i] for i in now})
    sizes = [sum(len(t.split()) for i, t in now.items() if source[i] == s) for s in names]
    goal = brute_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    for k, s in enumerate(names):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - goal[k]) <= max(len(now[r["doc_id"]].split()) for r in own)
        assert all(r["taken"] == r["copies"] * len(r["text"].split()) and r["copies"] <= 3 and r["text"] == now[r["doc_id"]] and r["source_size"] == sizes[k] for r in own)
