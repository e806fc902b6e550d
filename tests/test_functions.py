from pyspark.sql import functions as F

from kinlink.functions import similarity as sim
from kinlink.functions import text
from kinlink.operators import decide, stats
from kinlink.sources import tsv


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_transliteration():
    assert text.to_ascii("Élan œuvre") == "elan oeuvre"
    assert text.to_ascii("दिल्ली") == "dilli"
    assert text.to_ascii("कमल") == "kamal"
    assert text.to_ascii("संपत") == "sampat"
    assert text.to_ascii("कंसल्टिंग") == "kansalting"
    assert text.to_ascii("एलएलपी") == "elelapi"
    assert text.to_ascii("തെറ്റ") == text.to_ascii("തെട്ട")
    assert text.to_ascii("१२ कं") == "12 kam"
    assert text.to_ascii(None) == ""


def test_latin_text_stays_native(spark):
    texts = ["Élan œuvre Straße", "Łódź – “Ðuro” ‘x’", "ŞĞİ ǅ ĳ ﬁ", "naïve café Ø", "दिल्ली É", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["a"] for r in df.select("i", text.to_ascii_col(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in (0, 1, 3, 4, 5, 6)] == ["elan oeuvre strasse", "lodz - \"duro\" 'x'", "naive cafe o", "dilli e", "", ""]


def test_state(spark):
    rows = ["1 Main St, Austin, Texas", "Charleston, West Virginia", "3 rue X, Lyon, Rhône", "Salem, OR", None, "Texas, Ile-de-France, x", "a, महाराष्ट्र", "newyork, Gadag"]
    got = [tuple(r["s"]) for r in spark.createDataFrame([(i, a) for i, a in enumerate(rows)], "i int, a string").orderBy("i").select(text.split_state(F.col("a")).alias("s")).collect()]
    assert got[0] == ("1 Main St, Austin,  ", "tx") and got[1][1] == "wv" and got[2] == ("3 rue X, Lyon", "ara") and got[3] == ("Salem", "or")
    assert got[4] == ("", "") and got[5][1] == "idf" and got[6][1] == "mh" and got[7] == ("newyork, Gadag", "")


def test_names(spark):
    df = spark.createDataFrame([("R0cky Intl. Pvt Ltd",), ("hitech-engineering.com",), ("",), (None,)], "name string")
    out = [r[0] for r in df.select(text.name_parts(text.to_ascii_col(F.col("name")))).collect()]
    assert (out[0].core, out[0].legal) == (["rocky", "international"], ["pvt", "ltd"])
    assert (out[1].core, out[1].legal) == (["hitechengineering"], [])
    assert out[2].core == [] and out[3].core == []


def test_addresses(spark):
    a = one(spark, text.address_words(F.lit("#0012 north street, null zi 12")).alias("a"))["a"]
    assert a == ["0012", "n", "st", "z ind", "12"]
    assert one(spark, text.numbers(F.lit(["0012", "a7b08", "000"])).alias("n"))["n"] == ["12", "7", "8", "0"]
    assert one(spark, text.glued_numbers(F.lit(["0012", "a7b08", "000"])).alias("n"))["n"] == ["12", "708"]


def test_sound_keys(spark):
    keys = one(spark, *(text.phonetic(F.lit(w)).alias(w) for w in ("consulting", "kansalting", "private")), text.squash(F.lit("aabb1100")).alias("s"))
    assert keys["consulting"] == keys["kansalting"] == "knsltnk"
    assert keys["s"] == "ab10"


def test_similarity(spark):
    assert round(sim.ratio("kitten", "sitting"), 3) == 61.538
    assert sim.token_sort_ratio("b a", "a b") == 100.0
    assert sim.token_set_ratio("a b c", "a b") == 100.0
    assert sim.partial_ratio("abc", "xxabcxx") == 100.0
    assert round(sim.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert sim.lcs_length("", "abc") == 0
    empty = F.array().cast("array<string>")
    r = one(spark, sim.jaccard(empty, empty).alias("e"), sim.jaccard(F.lit(["a", "b"]), F.lit(["b", "c"])).alias("j"), sim.is_abbreviation(F.lit("bldg"), F.lit("building")).alias("b"))
    assert r["e"] == -1.0 and abs(r["j"] - 1 / 3) < 1e-9 and r["b"]
    o = one(spark, sim.idf_overlap(F.lit(["a", "b", "a"]), F.lit([1.0, 3.0, 1.0]), F.lit(["b"])).alias("o"))["o"]
    assert (o["share"], o["top_shared"], o["top_missing"]) == (0.75, 3.0, 1.0)


def test_f_half(spark):
    f = lambda *x: one(spark, decide.f_half(*map(F.lit, x)).alias("f"))["f"]
    assert f(0, 0, 0) == 1.0 and f(0, 1, 0) == 0.0 and f(0, 0, 2) == 0.0 and f(2, 2, 2) == 1.0
    assert abs(f(1, 2, 1) - 1.25 * 0.5 / (0.125 + 1)) < 1e-9


def test_quantile_map(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)], "g string, x double")
    out = stats.quantile_map(df, "g", "x", stats.quantiles(df, "g", "x"))
    assert all(abs(r["pct"] - r["x"] / 10) < 1e-9 for r in out.collect())


def test_tsv(spark, tmp_path):
    (tmp_path / "s.tsv").write_text('country\tentity_id\tbusiness_name\tbusiness_address\nFR\tS2-1\t"A" Co\t\n')
    r = tsv.records(spark, str(tmp_path / "s.tsv"), 2).first()
    assert (r["id"], r["name"], r["address"], r["src"]) == ("S2-1", '"A" Co', "", 2)
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-2\nS1-2\t\n")
    assert sorted(map(tuple, tsv.truth(spark, str(tmp_path / "t.tsv")).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    lists = spark.createDataFrame([("S1-2", None), ("S1-1", "S2-1")], "s1 string, m string")
    tsv.write_lists(lists, str(tmp_path / "out"), "s1", "m")
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text() == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n"
