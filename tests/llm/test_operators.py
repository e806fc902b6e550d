"""Operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; brute force where SQL has no form."""

import hashlib
import random
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kinlink.llm import decontamination, fingerprints, html_text, language_id, licenses, mixing, quality, simhash, substring_dedup, url_filter
from kinlink.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    """Texts with copies, shared passages, empty ones and a null."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(30)]
    texts = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(0, 120))]
        if i % 4 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 10) :]
        texts.append("\n\t ".join(w) if i % 5 == 0 else " ".join(w))
    texts[10] = texts[3]
    texts[20] = None
    texts[21] = "  \n"
    texts[30] = texts[3] + " extra"
    texts[40] = "very long " * 20_000
    return texts


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in zip(ids, texts)], DOCS)


def clashing(df):
    """Extra columns with names that the operators use inside."""
    for c in ("size", "fp", "id", "kind", "blob", "b", "score", "host", "slot", "_id", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 mixing


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 80], [5, 2, 1], 3) == [30.0, 30.0, 40.0]
    assert mixing.targets([0, 10], [5, 1], 3) == [0.0, 10.0]
    assert mixing.targets([], [], 3) == []


def test_fit_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        sums = {0}
        for size, c in zip(lengths, counts):
            sums = {s + k * size for s in sums for k in range(c + 1)}
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        got = mixing.fit_counts(lengths, counts, budget)
        total = sum(a * b for a, b in zip(got, lengths))
        assert all(0 <= g <= c for g, c in zip(got, counts)) and total <= budget
        # the proportional share of lengths comes first, so the best sum is met up to one document
        assert budget - total <= max(lengths)
    big = mixing.fit_counts([1, 7, 5000], [10**6, 10**6, 10**6], 10**9 + 3)
    assert 10**9 + 3 - sum(a * b for a, b in zip(big, [1, 7, 5000])) == 0


def test_mix(spark):
    docs = clashing(frame(spark, corpus()))
    one, two = ([tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()] for _ in range(2))
    assert one == two and len(one) == 60
    rows = mixing.mix(docs).collect()
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] or r["taken"] == 0) for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_long_group_is_exact(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 2500, "x").otherwise("y").alias("source"))
    rows = {r["source"]: r for r in mixing.mix(docs, weights=(1, 1)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    assert abs(rows["x"]["t"] - rows["x"]["g"]) <= 2 and abs(rows["y"]["t"] - rows["y"]["g"]) <= 2


def test_mix_of_equal_rows_is_exact(spark):
    docs = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 3000, "x").otherwise("y").alias("source"))
    rows = mixing.mix(docs, weights=(1, 2)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["source"]: r["n"] for r in rows} == {"x": 3000, "y": 1000} and all(abs(r["t"] - r["g"]) <= 3 for r in rows)


def test_many_lengths_are_met_exactly():
    rng = random.Random(12)
    for _ in range(20):
        lengths = rng.sample(range(1, 60_000), 3000)
        counts = [rng.randint(1, 4) for _ in lengths]
        budget = rng.randrange(sum(a * b for a, b in zip(lengths, counts)))
        got = mixing.fit_counts(lengths, counts, budget)
        assert sum(a * b for a, b in zip(got, lengths)) == budget and all(0 <= g <= c for g, c in zip(got, counts))


def brute_targets(sizes, weights, most):
    """Raises a common level of words for each unit of weight by small steps until all words are given out."""
    low, high, total = 0.0, 1e9, float(sum(sizes))
    for _ in range(200):
        level = (low + high) / 2
        given = sum(min(level * w, most * s) for s, w in zip(sizes, weights))
        low, high = (level, high) if given < total else (low, level)
    return [min(low * w, most * s) for s, w in zip(sizes, weights)]


def test_mix_against_brute_force(spark):
    texts = corpus()
    docs = clashing(frame(spark, texts))
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    source = [f"s{i % 3}" if i % 7 else None for i in range(len(texts))]
    size = [len((t or "").split()) for t in texts]
    names = sorted({s for s in source if s}) + [None]
    sums = [sum(z for z, s in zip(size, source) if s == n) for n in names]
    goal = brute_targets(sums, [(5, 2, 1)[i % 3] for i in range(len(names))], 3)
    for i, s in enumerate(source):
        assert (rows[i]["size"], rows[i]["source_size"]) == (size[i], sums[names.index(s)]) and abs(rows[i]["target"] - goal[names.index(s)]) < 1e-6 * max(sums)


def test_copies_meet_their_rows(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (1, "c d", None), (1, "e f", None), (1, "e f", None), (2, None, "s"), (3, "g " * 40, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit("own"))
    mixed = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()
    got = mixing.with_copies(docs)
    assert got.columns == ["doc_id", "text", "source", "copies"]
    words = got.withColumn("w", F.size(F.split(F.trim("text"), " ")) * F.col("copies")).groupBy("source").agg(F.sum("w").alias("t")).collect()
    assert {r["source"]: r["t"] for r in words} == {r["source"]: r["t"] for r in mixed if r["t"]}
    assert mixing.sample_mix(docs).count() == got.agg(F.sum("copies")).first()[0] and mixing.with_copies(empty(spark)).count() == 0


# 2 quality


def test_quality_learns_and_covers_the_whole_text(spark):
    rng = random.Random(2)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(1, 300)))
    texts = [good() for _ in range(300)]
    labels = [(i, int(i % 3 != 0)) for i in range(300)]
    texts = [t if y else t + " $$$ @@@ $$$ @@@" for t, (_, y) in zip(texts, labels)]
    docs = clashing(frame(spark, texts))
    net = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    with pytest.raises(ValueError, match="score"):
        quality.score(docs, net)
    out = {r["doc_id"]: r["mine"] for r in quality.score(docs, net, name="mine").withColumn("h", quality.held_out()).filter("h").collect()}
    assert np.mean([(s >= 0.5) == labels[i][1] for i, s in out.items()]) > 0.9


def brute_probability(net, text):
    """Byte by byte: every filter at every place of every chunk."""
    data = (text or "").encode()
    step, answers = quality.CHUNK - quality.OVERLAP, []
    for at in range(0, max(1, len(data) - quality.OVERLAP), step):
        chunk = data[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        places = [np.concatenate([net["embed"][b] for b in chunk[p : p + quality.SPAN]]) for p in range(0, quality.CHUNK - quality.SPAN + 1, quality.STEP)]
        answers.append([max(0.0, max(float(p @ net["filter"][:, f]) for p in places) + float(net["bias"][f])) for f in range(quality.FILTERS)])
    a = np.array(answers)
    z = np.concatenate([a.max(axis=0), a.mean(axis=0), a.min(axis=0)]) @ net["out"] + net["base"][0]
    return 1 / (1 + np.exp(-z))


def test_quality_against_brute_force(spark):
    net = quality.new_net(3)
    net["bias"] += 0.1
    texts = [None, "", "a", "two words", "x" * 512, "é" * 300, " ".join(f"w{i}" for i in range(400))]
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, texts), net).collect()}
    assert all(abs(got[i] - brute_probability(net, t)) < 2e-5 for i, t in enumerate(texts))


def test_quality_gradients():
    rng = np.random.default_rng(5)
    net = {k: v.astype(np.float64) for k, v in quality.new_net(4).items()}
    net["bias"] += 0.05
    texts = ["".join(map(chr, rng.integers(97, 122, n))) for n in (700, 30, 1500)]
    parts = [quality.chunks(t) for t in texts]
    x, size, y = np.concatenate(parts), np.array([len(p) for p in parts]), np.array([1.0, 0.0, 1.0])
    _, grad = quality.gradients(net, x, size, y)
    for k in net:
        for _ in range(12):
            at = tuple(int(rng.integers(97, 122)) if k == "embed" and i == 0 else int(rng.integers(n)) for i, n in enumerate(net[k].shape))
            h, was = 1e-6, net[k][at]
            net[k][at] = was + h
            up, _ = quality.gradients(net, x, size, y)
            net[k][at] = was - h
            down, _ = quality.gradients(net, x, size, y)
            net[k][at] = was
            assert abs((up - down) / (2 * h) - grad[k][at]) < 1e-6


def test_quality_takes_text_ids_and_repeated_rows(spark):
    rows = [(f"k{i}", "good words here" if i % 2 else "bad $$$ @@@") for i in range(60)] * 2
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    net = quality.train(docs, spark.createDataFrame([(f"k{i}", i % 2) for i in range(60)], "doc_id string, quality int"))
    out = quality.score(docs, net).collect()
    assert len(out) == 120 and all((r["score"] >= 0.5) == r["text"].startswith("good") for r in out)


def test_quality_edges(spark):
    assert sum(len(c) for c in quality.chunks(None)) == quality.CHUNK
    long = "x" * 100_000
    c = quality.chunks(long)
    assert (len(c) - 1) * (quality.CHUNK - quality.OVERLAP) + quality.CHUNK >= len(long)
    net = quality.new_net()
    rows = quality.score(frame(spark, [None, "", "a", "a", "long " * 600_000]), net).collect()
    assert all(0 <= r["score"] <= 1 for r in rows) and rows[0]["score"] == rows[1]["score"] and rows[2]["score"] == rows[3]["score"]
    assert quality.score(empty(spark), net).count() == 0
    none = quality.train(empty(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(frame(spark, ["a"]), none).first()["score"] == 0.5


# 3 substring dedup


def brute_substrings(rows, width=13):
    low, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            low.setdefault(tuple(words[i][k : k + width]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if low[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        left = [x for x, g in zip(w, gone) if not g]
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_substrings_against_brute_force(spark, batches):
    texts = corpus()
    docs = clashing(frame(spark, texts))
    got = {r[0]: tuple(r)[1:] for r in substring_dedup.dedup_substrings(docs, batches=batches, report=True).collect()}
    assert got == brute_substrings(list(enumerate(texts)))


def test_substrings_documents(spark):
    p = " ".join(f"w{i}" for i in range(20))
    docs = frame(spark, [p, "before  this\n" + p + "\nafter", p, None, ""])
    got = {r["doc_id"]: r["text"] for r in substring_dedup.dedup_substrings(docs).collect()}
    assert got == {0: p, 1: "before  this\nafter", 3: None, 4: ""}
    assert substring_dedup.dedup_substrings(empty(spark), report=True).count() == 0


def test_substrings_of_short_texts_only(spark):
    got = {r[0]: tuple(r)[1:3] for r in substring_dedup.dedup_substrings(frame(spark, ["a b", "a b", "c", None]), report=True).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (1, 0), 3: (0, 0)}


def test_substrings_same_or_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, p), (1, p), (None, p)], "doc_id long, text string")
    rows = sorted((r["doc_id"] is None, r["n_removed"]) for r in substring_dedup.dedup_substrings(docs, report=True).collect())
    assert rows == [(False, 0), (False, 0), (True, 20)]


def test_substrings_same_or_null_ids_at_other_places(spark):
    p = " ".join(f"w{i}" for i in range(20))
    rows = [(1, p)] + [(i, f"own{i}") for i in range(2, 5)] + [(i, t) for i in (8, None) for t in (f"{p} a{i}", f"some words before{i} {p}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 99, r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(docs, report=True).collect())
    assert got[4:] == [(8, 21, 20), (8, 23, 20), (99, 21, 20), (99, 23, 20)]


def test_substrings_tell_words_of_one_hash_polynomial_apart(spark):
    """Two words of 512 letters in Thue-Morse order and its opposite: equal under every polynomial modulo 2**64."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(512))
    b = a.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(12))
    got = {r[0]: r["n_removed"] for r in substring_dedup.dedup_substrings(frame(spark, [f"{head} {a}", f"{head} {b}", f"{head} {a}"]), report=True).collect()}
    assert got == {0: 0, 1: 0, 2: 13}
    (one, two), _ = substring_dedup.word_hashes(f"{a} {b} x x".encode())
    assert len(set(one.tolist())) == len(set(two.tolist())) == 3 and one[0] != two[0]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3000):
        arrays = [rng.integers(0, 1 << 15, n).astype(k) for k in ("<u8", "<i8", "<u4", "<i4", "<i2")]
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(arrays, substring_dedup._unpack(substring_dedup._pack(*arrays)), strict=True))
        one = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        back = substring_dedup._unpack_run(substring_dedup._pack_run(one, arrays[2]))
        assert (back[0] == one).all() and (back[1] == arrays[2]).all()


def test_substrings_refuse_text_ids(spark):
    with pytest.raises(ValueError, match="whole numbers"):
        substring_dedup.dedup_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_index_grows_and_compacts(spark, tmp_path):
    index = substring_dedup.FingerprintIndex(spark, f"file://{tmp_path}/index", 8)
    p = " ".join(f"w{i}" for i in range(20))
    for k in range(7):
        docs = frame(spark, [p, f"own{k} " * 20], ids=[10 * k, 10 * k + 1])
        got = {r[0]: r["n_removed"] for r in substring_dedup.dedup_substrings(docs, index=index, batches=1, report=True).collect()}
        assert got[10 * k] == (20 if k else 0) and got[10 * k + 1] == 0
    assert 1 <= len(index.runs) <= substring_dedup.FANOUT


# 4 URL filters


def test_rules_and_hosts(spark):
    urls = ["HTTP://A.Example.COM/en/x?q", "http://www.example.com/en/1#z", "http://x.net/es/", "http://x.net", "no host", None, "http://notexample.com/en/"]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    none = spark.createDataFrame([], "id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, none).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("net/es/", "block") and got[3] == ("x.net", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow") and got[6][2] == "com/"


def test_reputation_blocks_bad_hosts_only(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}") for i in range(400)]
    out = spark.createDataFrame([(i, i % 2) for i in range(300)], "id long, bad int")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), out).collect()
    assert all(r["verdict"] == ("block" if r["host"] == "bad.org" else "allow") for r in got)


def test_suffixes_and_empty_pages(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("x",), ("",), ("a.b.c.d.e",)], "h string")
    got = [tuple(r) for r in df.select(url_filter.suffix_of(F.col("h"), ["co.uk", "c.d.e"]), url_filter.domain_of(F.col("h"), ["co.uk", "c.d.e"])).collect()]
    assert got == [("co.uk", "b.co.uk"), ("com", "b.com"), ("x", "x"), ("", ""), ("c.d.e", "b.c.d.e")]
    none = spark.createDataFrame([], "id long, bad int")
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), none).count() == 0
    twice = spark.createDataFrame([(1, "http://a.co.uk/"), (1, "http://a.co.uk/"), (None, None)], "page_id long, url string")
    assert len({(r["page_id"], r["bad_low"]) for r in url_filter.judge(twice, none).collect()}) == 2 and url_filter.judge(twice, none).count() == 3


def brute_low(pages, bad, two):
    """Posterior bounds of hosts, level by level, in plain Python."""
    counts = {}
    for i, host in pages:
        n, k = counts.get(host, (0, 0))
        counts[host] = (n + (i in bad), k + bad.get(i, 0))
    label = lambda h, n: ".".join(h.split(".")[-n:])
    suffix = {h: label(h, 2) if label(h, 2) in two else label(h, 1) for h in counts}
    domain = {h: label(h, 3) if label(h, 2) in two else label(h, 2) for h in counts}
    add = lambda keys: {g: tuple(sum(counts[h][c] for h in counts if keys[h] == g) for c in (0, 1)) for g in set(keys.values())}
    by_suffix, by_domain = add(suffix), add(domain)
    total = [sum(c[x] for c in counts.values()) for x in (0, 1)]

    def level(groups, prior):
        some = [g for g, (n, _) in groups.items() if n]
        n = lambda g: groups[g][0]
        pages_ = sum(map(n, some))
        over = (sum(n(g) * (groups[g][1] / n(g) - prior[g]) ** 2 for g in some) - sum(prior[g] * (1 - prior[g]) for g in some)) / pages_
        inside = sum(n(g) * prior[g] * (1 - prior[g]) for g in some) / pages_
        m = 1000.0 if over <= inside / 1001 else min(max(inside / over - 1, 1.0), 1000.0)
        return m, {g: (m * prior[g] + groups[g][1]) / (m + n(g)) for g in groups}

    _, s = level(by_suffix, dict.fromkeys(by_suffix, (total[1] + 0.5) / (total[0] + 1)))
    _, d = level(by_domain, {domain[h]: s[suffix[h]] for h in counts})
    prior = {h: d[domain[h]] for h in counts}
    m, _ = level(counts, prior)
    out = {}
    for h, (n, k) in counts.items():
        a, b = m * prior[h] + k, m * (1 - prior[h]) + n - k
        out[h] = a / (a + b) - 1.645 * (a * b / ((a + b) ** 2 * (a + b + 1))) ** 0.5
    return out


def test_reputation_against_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.x.com", "b.x.com", "y.org", "c.z.co.uk", "w.co.uk", "v.net"]
    pages = [(i, rng.choice(hosts)) for i in range(300)]
    bad = {i: int(rng.random() < 0.15 * (1 + hosts.index(h))) for i, h in pages if i % 3}
    low = brute_low(pages, bad, url_filter.TWO_LABELS)
    out = url_filter.judge(spark.createDataFrame([(i, f"http://{h}/{i}") for i, h in pages], "page_id long, url string"), spark.createDataFrame(sorted(bad.items()), "id long, bad int"), rules=())
    for r in out.collect():
        assert abs(r["bad_low"] - low[r["host"]]) < 2e-6 and r["verdict"] == ("block" if low[r["host"]] > 0.5 else "allow")
    assert len({r["verdict"] for r in out.collect()}) == 2


# 5 SimHash


def brute_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_duplicates_against_brute_force(spark):
    texts = corpus(n=50) + ["a b c d"] * 5
    texts[40] = "short"
    got = {r[0]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(clashing(frame(spark, texts))).collect()}
    fps = [brute_fingerprint(t, 3) for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, comp))}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_links_find_every_close_pair(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(300)]
    fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in fps[:200]]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in set(fps)], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(df)).collect()}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    for f, g in zip(fps[:200], fps[300:]):
        assert f == g or roots[signed(f)] == roots[signed(g)]


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in connected_components(edges).collect()} == {0}


def test_links_of_a_hot_key(spark, monkeypatch):
    """Keys that many fingerprints share are divided without losing a link."""
    monkeypatch.setattr(simhash, "HOT", 8)
    rng = random.Random(11)
    fps = {0xDEADBEEF << 32 | rng.getrandbits(32) for _ in range(300)}
    fps |= {f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in list(fps)[:150]}
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    roots = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"))).collect()}
    comp = list(range(len(fps)))
    for _ in range(12):
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
    classes = {}
    for f, c in zip(fps, comp):
        classes.setdefault(c, set()).add(roots.get(signed(f), signed(f)))
    assert all(len(x) == 1 for x in classes.values()) and len({min(x) for x in classes.values()}) == len(classes)


def jaccard(a, b, n=5):
    sets = [{tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if (w := (t or "").lower().split()) else set() for t in (a, b)]
    return 1.0 if not (sets[0] | sets[1]) else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("hot", [4096, 3])
def test_similar_groups_against_brute_force(spark, monkeypatch, hot):
    """All pairs from 0.8 by shingles are joined, up to the planned recall, and nothing below."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(7)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    texts += [None, "", "  ", "a b", "A B", "a b c"]
    got = {r["doc_id"]: r["group"] for r in simhash.similar_groups(clashing(frame(spark, texts))).collect()}
    n = len(texts)
    pairs = [(i, j) for i in range(n) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.93 * len(pairs) and len(pairs) > 40
    comp = list(range(n))
    for _ in range(6):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert all(comp[i] == comp[j] for i in range(n) for j in range(i) if got[i] == got[j])


@pytest.mark.parametrize("hot", [4096, 3])
def test_similar_groups_beyond_the_nearest(spark, monkeypatch, hot):
    """a near-duplicate is found though other texts' fingerprints are nearer to both."""
    import numpy as np

    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "wide_fingerprint", lambda hashes, words: np.array([len(hashes)] + [0] * (words - 1), np.uint64))
    words = [f"w{i}" for i in range(131)]
    texts = [" ".join(words), " ".join(words[:124])]  # 127 and 120 shingles; three bits apart, one or two from the others
    texts += [" ".join(f"{n}x{i}" for i in range(n + 4)) for n in (121, 122, 123, 124, 125, 126)]
    got = {r["doc_id"]: r["group"] for r in simhash.similar_groups(frame(spark, texts)).collect()}
    a, b = sorted(got)[:2]
    assert got[a] == got[b] and len(set(got.values())) == 7


@pytest.mark.parametrize("block", [1024, 20])
def test_similar_groups_of_many_near_copies(spark, monkeypatch, block):
    """copies of one text that are just not alike make no row for each pair, and lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "COUNTED", 300, raising=False)
    seen, verified = [], simhash.verified
    monkeypatch.setattr(simhash, "verified", lambda edges, *more: seen.append(edges.count()) or verified(edges, *more))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(5, 145), rng.choice((1, 1, 2, 3, 4))):
            w[k] = f"x{i}y{k}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["group"] for r in simhash.similar_groups(frame(spark, texts)).collect()}
    comp = list(range(len(texts)))
    pairs = [(i, j) for i in comp for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    for _ in range(9):
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    ids = sorted(got)
    assert len(set(comp)) > 5 and all((got[ids[i]] == got[ids[j]]) == (comp[i] == comp[j]) for i in range(len(ids)) for j in range(i))
    assert sum(seen) <= len(texts)


def test_rows_of_a_key_are_connected_over_the_first_one():
    """clusters are the components of all pairs within the radius, not only of the nearest ones."""
    import numpy as np

    rng = random.Random(4)
    for m in (2, 3, 40, 300):
        fps = np.array([[(1 << rng.randrange(9)) - 1 | rng.getrandbits(8) << 20] for _ in range(m)], np.uint64)
        u, v, low = simhash.nearest_before(fps, 2)
        want = list(range(m))
        for _ in range(12):
            want = [min(want[j] for j in range(m) if (int(fps[i, 0]) ^ int(fps[j, 0])).bit_count() <= 2) for i in range(m)]
        assert low.tolist() == want and (v < u).all()


def test_segments_follow_the_recall():
    for count in (0, 10, 10**4, 10**6, 10**9):
        parts, width, words, radius = simhash.segments_for(count)
        q = simhash.differing(0.8)
        one = (1 - q) ** width + width * q * (1 - q) ** (width - 1)
        assert 1 - (1 - one) ** parts >= 0.95 and words * 64 >= parts * width and radius < words * 32


def test_one_of_each(spark):
    text = lambda p, n=120: " ".join(f"{p}{i}" for i in range(n))
    near = text("b").replace("b60 ", "changed ")
    rows = [("k1", text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (None, near), ("z", text("c")), ("z", text("c")), ("z", text("d")), ("e", None), ("f", "")]
    got = sorted(((r["doc_id"] or "-"), r["text"]) for r in simhash.one_of_each(clashing(spark.createDataFrame(rows, "doc_id string, text string"))).collect())
    assert [x for x in got if x[0] != "-"] == [("e", None), ("k1", text("a")), ("z", text("c")), ("z", text("d"))]
    assert len(got) == 5 and got[0][1] in (text("b"), near)
    assert simhash.one_of_each(empty(spark)).count() == 0


# 6 decontamination


def test_leaks(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions tonight"
    edited = item.replace("lazy", "sleepy").upper() + "!!"
    docs = clashing(frame(spark, ["before " + item + " after", "x " * 50 + edited, "nothing here at all", None, "", item[: len(item) // 2]]))
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "?!")], "item_id long, text string")
    got = sorted((r["id"], r["item"], r["edits"]) for r in decontamination.find_leaks(docs, bench).collect())
    assert got == [(0, 7, 0), (1, 7, 1)]
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontamination.find_leaks(empty(spark), bench).count() == 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        words[i : i + (kind != 2)] = [] if kind == 1 else ["zz"]
    return words


@pytest.mark.parametrize("n", [12, 20, 40, 80])
def test_recall_at_the_largest_number_of_edits(n):
    rng = random.Random(n)
    items = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(n))) for i in range(50)]
    search, found = decontamination.Items(items), 0
    for key, text in items:
        for _ in range(2):
            w = edited(rng, text.split(), decontamination.allowed(n))
            found += any(k == key for k, _, _ in search.search(search.numbers.of(" ".join(["aa"] * 20 + w + ["bb"] * 20))))
    assert found >= 95


def brute_distance(item, words):
    """Fewest edits between the item and any stretch of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_leaks_against_brute_force(spark, kind):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(40)}"
    items = [[word() for _ in range(rng.choice((9, 14, 22, 60)))] for _ in range(12)]
    docs = [[word() for _ in range(rng.randint(0, 80))] for _ in range(30)]
    for i, d in enumerate(docs):
        if i % 2:
            item = rng.choice(items)
            d[len(d) // 2 : len(d) // 2] = edited(rng, item, rng.randint(0, decontamination.allowed(len(item)) + 1))
    key = str if kind == "string" else int
    bench = spark.createDataFrame([(key(i), " ".join(x)) for i, x in enumerate(items)] + [(key(3), " ".join(items[3]))], f"item_id {kind}, text string")
    table = spark.createDataFrame([(key(i), " ".join(d)) for i, d in enumerate(docs)], f"doc_id {kind}, text string")
    out = decontamination.find_leaks(table, bench)
    assert out.schema["item"].dataType == bench.schema["item_id"].dataType
    got = {(int(r["id"]), int(r["item"])) for r in out.collect()}
    want = {(i, k) for i, d in enumerate(docs) for k, x in enumerate(items) if brute_distance(x, d) <= decontamination.allowed(len(x))}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 10


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_CHARS", 60)
    rng = random.Random(9)
    items = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(10))) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = clashing(frame(spark, [t for _, t in items] + [None, "", "clean text", "a " * 200_000]))
    assert sorted((r["id"], r["item"]) for r in decontamination.find_leaks(docs, bench).collect()) == [(i, i) for i in range(5)]
    assert sorted(r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()) == [5, 6, 7, 8]
    assert decontamination.find_leaks(docs, bench.limit(0)).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).count() == 9


def test_distance():
    d = decontamination.distance_within
    assert d(list("abcd"), list("xxabcdxx"), 2) == 0 and d(list("abcd"), list("xxabdxx"), 2) == 1 and d(list("abcd"), list("zzzz"), 2) == 3


# 7 licences


def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Some One\n\n" + licenses.MIT.upper().replace('"', "'")
    british = "Licenced under the Apache Licence, Version 2.0"
    docs = clashing(frame(spark, [mit, british, licenses.MIT + " and more", None, "", british, "word " * 300_000]))
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: None, 3: None, 4: None, 5: "Apache-2.0", 6: None}
    assert licenses.scan(empty(spark)).count() == 0


def wrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


@pytest.mark.parametrize("width", [40, 60, 66, 72, 80])
def test_wrapped_licences(spark, width):
    """Wherever lines break, also before "copyright notice", with the holder's line before."""
    known = [("ISC", licenses.ISC), ("MIT", licenses.MIT), ("BSD-2-Clause", licenses.BSD_TWO), ("BSD-3-Clause", licenses.BSD_THREE), ("Zlib", licenses.ZLIB)]
    texts = [f"{head}\n\n{wrapped(t, width)}\n" for _, t in known for head in ("Copyright (c) 1999-2020, Some One", "Copyright © Some One\nAll rights reserved.", "# Copyright 2001 by X <x@y.org>")]
    got = [r["license"] for r in licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [name for name, _ in known for _ in range(3)]


def test_spellings_next_to_each_other(spark):
    df = spark.createDataFrame([("The owner owner owners, whilst LICENCE",)], "t string")
    assert df.select(licenses.canonical(F.col("t"))).first()[0] == "the holder holder holders while license"


def test_licences_of_a_table(spark):
    known = spark.createDataFrame([("Own-1.0", "You may do\nanything."), ("Own-1.0", ""), ("Other", None)], "license string, text string")
    got = {r["doc_id"]: r["license"] for r in licenses.scan(frame(spark, ["YOU MAY do anything!", "", licenses.ZLIB]), known=known).collect()}
    assert got == {0: "Own-1.0", 1: None, 2: "Zlib"}


def test_digests_of_published_texts(spark):
    import pathlib

    where = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0"}
    if not where.is_dir():
        pytest.skip("no licence texts here")
    docs = spark.createDataFrame([(n, (where / f).read_text()) for f, n in names.items()], "doc_id string, text string")
    assert all(r["doc_id"] == r["license"] for r in licenses.scan(docs).collect())


# 8 HTML


def test_html_lines():
    page = """<html><head><title>T</title><style>p{}</style><script>x="</p>"</script></head><body><nav>menu</nav><!-- c --><div class="ad">buy</div>
    <article><h1>Head &amp;  more</h1><p><b>one<br>two<p>three &lt;b&gt;</p><div class="comments"><p>first!</p></div><form>f</form><ul><li>a<li>b</ul></article><aside>side</aside><footer>&copy;</footer>"""
    assert html_text.lines_of(page)[1] == ["Head & more", "one two", "three <b>", "a", "b"]
    assert html_text.lines_of(None) == (b"", []) and html_text.lines_of("<") == (bytes([html_text.OTHER]), ["<"])
    assert html_text.lines_of("plain & text")[1] == ["plain & text"]


def test_html_differencing(spark):
    make = lambda x: f"<body><div>Site name</div><p>{x}</p><div>All rights</div></body>"
    rows = [(i, f"http://h.com/a/{i}", make(f"text {i}")) for i in range(6)] + [(9, "http://alone.com/", make("alone")), (10, None, None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")).coalesce(1)).collect()}
    assert got[9] == "Site name\nalone\nAll rights" and got[10] == ""
    assert sum(got[i] == f"text {i}" for i in range(6)) >= 4
    same = [(i, f"http://c.com/{i}", "<article><p>same</p></article>") for i in range(3)]
    assert {r["text"] for r in html_text.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()} == {"same"}


def test_html_marked_wrappers():
    page = '<body><div class="layout has-sidebar banner"><p>out</p><article><h1>Head</h1><div class="post-header">by</div><p class="notices-of-birth">a</p><div class="comments"><article class="comment">c</article></div></article></div>'
    assert html_text.lines_of(page)[1] == ["Head", "by", "a"]
    assert html_text.lines_of('<div id="page" class="with-banner"><main>in</main></div>')[1] == ["in"]
    assert html_text.lines_of("<div hidden><article>no</article></div><nav><article>no</article></nav><p>b</p>")[1] == ["b"]


def test_html_differencing_across_ranges(spark):
    make = lambda x: f"<body><div>Site name</div><p>{x}</p><div>All rights</div></body>"
    rows = [(i, f"http://h.com/a/{i}", make(f"text {i}")) for i in range(40)] + [(99, None, None)]
    for parts in ("1", "4", "30"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == {**{i: f"text {i}" for i in range(40)}, 99: ""}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_shared(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 6])
def test_shared_lines(monkeypatch, bits):
    monkeypatch.setattr(html_text, "TABLE_BITS", bits)
    assert html_text.shared_lines(list("axbyc"), list("abzc")) == {0, 2, 4}
    assert html_text.shared_lines([], ["a"]) == set()
    rng = random.Random(4)
    for _ in range(500):
        a, b = ([rng.choice("abcdexyz"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        got = sorted(html_text.shared_lines(a, b))
        rest = iter(b)
        assert len(got) == brute_shared(a, b) and all(a[i] in rest for i in got)


def brute_pages(rows):
    """Texts of pages (id, url, lines outside an article, lines in one): nearest path of the host by a scan over all its pages."""
    split = lambda u: (u.split("://")[1].split("/")[0], ["", *u.split("://")[1].split("/")[1:]])
    out = {}
    for i, url, around, inside in rows:
        if inside is not None:
            out[i] = "\n".join(inside)
            continue
        host, path = split(url)
        key = lambda r: (split(r[1])[1], r[0], r[1])
        own = sorted((r for r in rows if split(r[1])[0] == host), key=key)
        at = [r[0] for r in own].index(i)
        near = sorted((html_text.apart(path, split(own[k][1])[1]), k) for k in (at - 1, at + 1) if 0 <= k < len(own))
        text = list(around)
        for _, k in near:
            other = [*own[k][2], *(own[k][3] or [])]
            shared = html_text.shared_lines(around, other)
            if sum(len(around[x]) for x in shared) < html_text.COPY * sum(map(len, around)):
                text = [x for n, x in enumerate(around) if n not in shared]
                break
        out[i] = "\n".join(text)
    return out


def test_html_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        host, section = f"h{rng.randrange(3)}.com", rng.choice(("news", "blog/a", "blog/b"))
        around = [f"site {host}", f"section {section}", f"own words of page {i} that are long enough to count as text", "all rights reserved"]
        inside = [f"article {i}", "a shared quotation"] if i % 7 == 0 else None
        rows.append((i, f"http://{host}/{section}/{rng.randrange(40)}", around, inside))
    make = lambda around, inside: "<body>" + "".join(f"<div>{x}</div>" for x in around) + (f"<article>{''.join(f'<p>{x}</p>' for x in inside)}</article>" if inside else "") + "</body>"
    pages = spark.createDataFrame([(i, u, make(a, x)) for i, u, a, x in rows], "page_id long, url string, html string")
    want, before = brute_pages(rows), spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert {r["page_id"]: r["text"] for r in html_text.extract(pages.repartition(int(parts))).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_html_copies_and_repeated_rows(spark):
    lines = "<body><div>Site</div><div>A long text that two addresses of the host both show to their readers.</div></body>"
    other = "<body><div>Site</div><div>Something else.</div></body>"
    rows = [(1, "http://a.com/x", lines), (1, "http://a.com/x", lines), (2, "http://a.com/x/", lines), (3, "http://a.com/y", other)]
    got = sorted((r["page_id"], r["text"]) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert len(got) == 4 and all("A long text" in t for i, t in got if i < 3) and got[3] == (3, "Something else.")


@pytest.mark.parametrize("page", ['<a b="' * 170_000, "<" * 1_000_000, "<div>" * 100_000 + "</p>" * 100_000, "<![CDATA[" * 100_000, "<!" * 500_000, "<p>same</p>" * 90_000])
def test_malformed_pages_take_linear_time(page):
    begin = time.perf_counter()
    kinds, lines = html_text.all_lines(page)
    html_text.main_text(kinds, lines, [lines[1:]])
    assert time.perf_counter() - begin < 8


# 9 languages


def test_languages(spark):
    docs = spark.createDataFrame([(1, "the house and the garden with the tree " * 20, "en"), (2, "das haus und der garten mit dem baum " * 20, "de")], "doc_id long, text string, lang string")
    page = lambda t, lang="": f"<html{lang}><body><p>{t}</p></body></html>"
    rows = [(1, "http://a.de/1", page("der baum und das haus", ' lang="de"')), (2, "http://a.de/2", page("the tree and the house with the garden")), (3, "http://a.de/3", page("")), (4, None, None), (5, "http://a.de/4", page("mit dem baum"))]
    got = {r["page_id"]: r for r in language_id.identify(clashing(spark.createDataFrame(rows, "page_id long, url string, html string")), language_id.train(docs)).collect()}
    assert got[1]["lang"] == got[5]["lang"] == "de" and got[2]["lang"] == "en" and got[1]["declared"] == "de" and len(got) == 5


def test_declared_language_anywhere():
    long = "x" * 30_000
    assert language_id.declared_language(f'<!-- {long} <html lang="fr"> --><script>"<body lang=es>{long}"</script><html><body class="a" lang="de-AT">') == "de"
    assert language_id.declared_language(f'<style>{long}</style><html lang="en"><body lang="de">') == "en"
    assert language_id.declared_language(None) is None and language_id.declared_language("<body " * 50_000) is None


def test_languages_learn_from_whole_texts(spark):
    docs = spark.createDataFrame([(1, "1 " * 15_000 + "the house and the garden " * 20, "en"), (2, "1 " * 15_000 + "das haus und der garten " * 20, "de"), (3, "", "xx")], "doc_id long, text string, lang string")
    langs, table = language_id.train(docs)
    assert langs == ["de", "en", "xx"]
    for text, lang in (("the garden and the house", "en"), ("der garten und das haus", "de")):
        sums = sum(table[g].sum(axis=0) for g in language_id.strips(text))
        assert langs[sums[:2].argmax()] == lang and abs(sums[0] - sums[1]) > 1


def test_languages_edges(spark):
    docs = spark.createDataFrame([("k1", "the house and the garden " * 20, "en"), ("k2", "das haus und der garten " * 20, "de"), (None, "x", "en"), ("k3", None, "fr")], "doc_id string, text string, lang string")
    models = language_id.train(docs)
    assert models[0] == ["de", "en"]
    long = "<p>" + "der garten " * 60_000 + "</p>"
    rows = [(1, "http://a.x/1", long), (1, "http://a.x/1", long), (2, "http://b.y/de/2", ""), (3, None, None), (4, "http://c.z/", "<p>12 34</p>")]
    got = sorted((r["page_id"], r["lang"], 0 < r["prob"] <= 1) for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), models).collect())
    assert len(got) == 5 and got[0] == got[1] == (1, "de", True) and all(x[2] for x in got)
    assert language_id.identify(spark.createDataFrame([], "page_id long, url string, html string"), models).count() == 0
    none = language_id.train(docs.limit(0))
    assert {r["lang"] for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), none).collect()} == {"und"}


def brute_languages(langs, pages):
    """Fusion in plain Python from (host, domain, suffix, log-likelihoods, declared)."""
    k = len(langs)
    soft = lambda x: (lambda e: [v / sum(e) for v in e])([np.exp(v - max(x)) for v in x])
    wrong = (1 - language_id.DECLARED_RIGHT) / max(1, k - 1)
    logs = [[x + (np.log(language_id.DECLARED_RIGHT if d == lang else wrong) if d in langs else 0.0) for x, lang in zip(lg, langs)] for _, _, _, lg, d in pages]
    first = [soft(x) for x in logs]
    total = [sum(p[i] for p in first) + 1 for i in range(k)]
    base = [x / sum(total) for x in total]

    def others(at, col):
        return [sum(first[j][i] for j in range(len(pages)) if pages[j][col] == pages[at][col] and j != at) for i in range(k)]

    def shrink(own, parent, worth):
        return [(a + b * worth) / (sum(own) + worth) for a, b in zip(own, parent)]

    out = []
    for at in range(len(pages)):
        d = shrink(others(at, 1), base, language_id.DOMAIN_PAGES)
        h = shrink(others(at, 0), d, language_id.HOST_PAGES)
        s = [a / b for a, b in zip(shrink(others(at, 2), base, language_id.SUFFIX_PAGES), base)]
        post = soft([x + np.log(a) + np.log(b) for x, a, b in zip(logs[at], h, s)])
        out.append((langs[int(np.argmax(post))], max(post)))
    return out


def test_languages_against_brute_force(spark):
    rng = random.Random(13)
    docs = spark.createDataFrame([(1, "the house and the garden with trees " * 9, "en"), (2, "das haus und der garten mit baum " * 9, "de"), (3, "la maison et le jardin avec arbre " * 9, "fr")], "doc_id long, text string, lang string")
    langs, table = language_id.train(docs)
    words = "the house and garden das haus und der garten la maison et le jardin".split()
    rows, pages = [], []
    for i in range(40):
        text, lang, host = " ".join(rng.choice(words) for _ in range(rng.randint(0, 6))), rng.choice(["en", "de", "xx", None]), f"{rng.choice('ab')}.{rng.choice('xy')}.com"
        segment = rng.choice(["de", "fr", "page"])
        rows.append((i, f"http://{host}/{segment}/{i}", f"<html{f' lang={lang}' if lang else ''}><body><p>{text}</p></body></html>"))
        data = b" " + text.lower().encode() + b" "
        x = [32 if c < 65 else c for c in data]
        grams = [((((a << 16) | (b << 8) | c) * 2654435761) % (1 << 32)) >> 17 for a, b, c in zip(x, x[1:], x[2:])] if text else []
        score = [float(sum(float(table[g][j]) for g in grams)) for j in range(len(langs))]
        pages.append((host, host[2:], f"com/{segment if len(segment) == 2 else ''}", [v * 60 / (60 + len(grams)) for v in score], lang))
    got = {r["page_id"]: (r["lang"], r["prob"]) for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), (langs, table)).collect()}
    for i, (lang, p) in enumerate(brute_languages(langs, pages)):
        assert abs(got[i][1] - p) < 1e-4 and (got[i][0] == lang or p < 0.51)


# 10 fingerprints


def test_fingerprints_against_brute_force(spark):
    texts = corpus(n=55)
    texts[40] = "long " * 3000
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(clashing(frame(spark, texts))).collect()}
    plain = [t or "" for t in texts]
    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
    for i, t in enumerate(plain):
        after, q, r = plain[(i + 1) % len(plain)], len(t) // 4, got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()
        assert r["near_edited"] == alike(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == alike(r["fingerprint"], got[(i + 1) % len(plain)]["fingerprint"])
        if i % 50 == 0:
            assert r["n_near"] == sum(alike(r["fingerprint"], got[j]["fingerprint"]) >= 61 / 64 for j in got) - 1
    assert got[3]["fingerprint"] == got[10]["fingerprint"] and got[20]["fingerprint"] == "0" * 16
    assert fingerprints.fingerprint_report(empty(spark)).count() == 0


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(9)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    fps = [rng.getrandbits(64) for _ in range(100)]
    near = []
    for f in fps:
        for b in rng.sample(range(64), 3):
            f ^= 1 << b
        near.append(f)
    q, d = (spark.createDataFrame([(signed(f),) for f in x], "fp long") for x in (fps, near))
    found = [(r["q"], r["fp"]) for r in fingerprints.search(q, d).collect()]
    assert len(found) == len(set(found)) and {(signed(a), signed(b)) for a, b in zip(fps, near)} <= set(found)


def test_next_with_repeated_and_null_ids(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "z"), (5, None), (-(1 << 63), "low"), ((1 << 63) - 1, "high"), *((i, f"t{i}") for i in range(1000, 1100))]
    got = fingerprints.fingerprint_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    texts = spark.createDataFrame([(t,) for t in sorted({t or "" for _, t in rows})], "text string")
    key = {r["k"]: f"{r['text_fp'] % (1 << 64):016x}" for r in fingerprints.with_fingerprints(texts.withColumn("k", F.col("text")), ["k"], ["text"]).collect()}
    place = {r["text"]: r["h"] for r in texts.select("text", F.xxhash64("text").alias("h")).collect()}
    line = ["low", *sorted(["a", "b", "b"], key=place.get), "", *(f"t{i}" for i in range(1000, 1100)), "high", "z"]
    alike = lambda a, b: 1 - (int(key[a], 16) ^ int(key[b], 16)).bit_count() / 64
    want = sorted((key[a], alike(a, b)) for a, b in zip(line, line[1:] + line[:1]))
    assert sorted((r["fingerprint"], r["near_next"]) for r in got) == want


def test_slots_are_even_whatever_the_ids(spark):
    for ids in (list(range(5000)) + [1 << 62], [i * i * i for i in range(5000)]):
        df = spark.createDataFrame([(i,) for i in ids], "id long")
        slot, _ = fingerprints.slots(df, "id", F.lit(0).cast("long"))
        sizes = [r["count"] for r in df.groupBy(slot.alias("s")).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * len(ids) / 16
        ordered = [r["s"] for r in df.withColumn("s", slot).orderBy("id").collect()]
        assert ordered == sorted(ordered)


def test_sql_of_substring_dedup(spark, tmp_path):
    import duckdb

    from kinlink.llm.queries import SQL, op3_substring_dedup

    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    ours = sorted(tuple(r) for r in op3_substring_dedup(spark, str(tmp_path)).select(*names).collect())
    assert ours == sorted(con.sql(SQL["op3_substring_dedup"]).select(*names).fetchall())
