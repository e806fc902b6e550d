"""Features of a pair of records: the clean one's columns begin with a_, the noisy one's with b_.

Sets, numbers, counts and the pairing of words are native. Character ratios and misspellings run in Arrow UDFs.
Where one side has nothing to compare, a feature is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .similarity import idf_overlap, is_abbreviation, jaccard, jaro_winkler, jaro_winkler_udf, levenshtein_similarity, partial_udf, ratio_udf, token_set_udf, token_sort_udf
from .text import non_latin, squash
from .words import tokens

NOTHING = -1.0
#: Similarity from which a differing token is a misspelling rather than another word (fixed value).
TYPO = 0.85
#: Weight from which a token counts as unseen in its country (fixed value).
UNSEEN = 12.4


def _or_nothing(ok: Column, value: Column) -> Column:
    return F.when(ok, value.cast("double")).otherwise(F.lit(NOTHING))


def _any(xs: Column, ys: Column, test) -> Column:
    return F.exists(xs, lambda x: F.exists(ys, lambda y: test(x, y)))


def _edge(x: Column, y: Column) -> Column:
    """One is a proper beginning or end of the other."""
    return (x != y) & (x.startswith(y) | y.startswith(x) | x.endswith(y) | y.endswith(x))


def log_gap(a: Column, b: Column) -> Column:
    """ln(1 + difference) of the first twelve digits."""
    n = lambda x: F.substring(x, 1, 12).try_cast("long")
    return F.coalesce(F.log1p(F.abs(n(a) - n(b)).cast("double")), F.lit(NOTHING))


def first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def number_noise(a: Column, b: Column) -> Column:
    """Seven signs that tell a misprinted number from another one; -1 if a side has none."""
    x, y, some = first(a), first(b), (F.size(a) > 0) & (F.size(b) > 0)
    same = F.char_length(x) == F.char_length(y)
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    differ = F.size(F.filter(F.zip_with(chars(x), chars(y), lambda p, q: p != q), lambda t: t))
    edits = F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: F.levenshtein(p, q)))))
    return F.struct(
        _or_nothing(some, same & (x != y)).alias("same_length_differs"), _or_nothing(some, (x != y) & (x.startswith(y) | y.startswith(x))).alias("prefix"),
        _or_nothing(some, (x != y) & (x.endswith(y) | y.endswith(x))).alias("suffix"), _or_nothing(some, log_gap(x, y)).alias("log_gap"),
        _or_nothing(some & same, differ).alias("hamming"), _or_nothing(some, edits).alias("min_edits"), _or_nothing(some, F.size(F.array_except(b, a))).alias("missing"),
    )


def number_agreement(o: Column, s: Column) -> Column:
    """Ten signs over the number lists of a noisy record and a clean one; edits look at the first three of each."""
    some = (F.size(o) > 0) & (F.size(s) > 0)
    p, q = F.slice(o, 1, 3), F.slice(s, 1, 3)
    common = F.size(F.array_intersect(o, s))
    fewest = F.array_min(F.flatten(F.transform(p, lambda x: F.transform(q, lambda y: F.levenshtein(x, y)))))
    flag = lambda c: F.when(some, c.cast("int")).otherwise(F.lit(0))
    return F.struct(
        F.size(o).alias("n_o"), F.size(s).alias("n_s"), flag(common).alias("common"), F.when(some, jaccard(o, s)).otherwise(F.lit(0.0)).alias("jac"),
        flag(first(o) == first(s)).alias("first_equal"), F.when(some, fewest).otherwise(F.lit(9)).alias("best_edit"), flag(_any(p, q, _edge)).alias("truncated"),
        flag((common == 0) & _any(p, q, lambda x, y: (F.char_length(x) == F.char_length(y)) & (F.levenshtein(x, y) == 1))).alias("sibling"),
        flag((F.size(F.array_except(o, s)) == 0) & (F.size(F.array_except(s, o)) == 0)).alias("same_set"), _or_nothing(some, log_gap(first(o), first(s))).alias("log_gap"),
    )


def joined_names(a: Column, b: Column) -> Column:
    """Whether a glued name of four letters and more holds the other, and whether they are equal."""
    long = (F.char_length(a) >= 4) & (F.char_length(b) >= 4)
    return F.struct((long & (F.contains(a, b) | F.contains(b, a))).cast("int").alias("inside"), ((a == b) & (a != "")).cast("int").alias("equal"))


def shortens(short: Column, long: Column) -> Column:
    """A shorter word with the same first letter, whose letters occur in the longer one in order."""
    return (F.char_length(short) < F.char_length(long)) & is_abbreviation(short, long)


def abbreviation_cover(a: Column, b: Column) -> Column:
    """struct(cover_a, cover_b, n_short, first): shares of both lists that pair up as equal or abbreviated words.

    Words of ``a`` choose in order: an equal word of ``b`` that is free, else the first free one that either
    abbreviates. n_short counts the latter; first: whether the first words of both pair.
    """
    alike = lambda x, y: shortens(x, y) | shortens(y, x)
    none = F.lit(None).cast("string")

    def step(s: Column, word: Column) -> Column:
        pick = F.when(F.array_contains(s["free"], word), word).otherwise(F.get(F.filter(s["free"], lambda u: alike(word, u)), F.lit(0)))
        return F.struct(
            F.when(pick.isNull(), s["free"]).otherwise(F.array_remove(s["free"], F.coalesce(pick, F.lit("")))).alias("free"),
            (s["paired"] + pick.isNotNull().cast("int")).alias("paired"), (s["short"] + F.coalesce(pick != word, F.lit(False)).cast("int")).alias("short"),
        )

    x, y = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    names = F.array_distinct(y)
    done = F.aggregate(x, F.struct(names.alias("free"), F.lit(0).alias("paired"), F.lit(0).alias("short")), step)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    head, other = F.coalesce(first(x), none), F.coalesce(first(y), none)
    return F.struct(
        F.when(some, done["paired"] / F.size(x)).otherwise(F.lit(0.0)).alias("cover_a"), F.when(some, (F.size(names) - F.size(done["free"])) / F.size(y)).otherwise(F.lit(0.0)).alias("cover_b"),
        F.when(some, done["short"]).otherwise(F.lit(0)).alias("n_short"), F.when(some, ((head == other) | alike(head, other)).cast("int")).otherwise(F.lit(0)).alias("first"),
    )


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def misspelled_udf(words, known):
    """Which of the words are close to a known one; pairs of words are compared once a batch."""
    import functools

    import pandas as pd

    close = functools.cache(lambda x, y: jaro_winkler(x, y) >= TYPO)
    return pd.Series([[any(close(x, y) for y in k) for x in w] for w, k in zip(words, known, strict=True)])


def align(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    """struct(typos, others, gone, other_min, other_max, gone_min) of two token lists and their weights.

    Tokens of b that a lacks are misspellings of one of a's or other words; gone are tokens of a that b lacks.
    """
    z = lambda x, w, there: F.filter(F.arrays_zip(x.alias("t"), w.alias("w")), lambda e: e["t"].isNotNull() & ~F.array_contains(there, e["t"]))
    new, gone = z(b, wb, a), z(a, wa, b)
    typo = misspelled_udf(F.transform(new, lambda e: e["t"]), F.array_distinct(a))
    marked = F.zip_with(new, typo, lambda e, m: F.struct(e["w"].alias("w"), m.alias("m")))
    other = F.transform(F.filter(marked, lambda e: ~e["m"]), lambda e: e["w"].cast("double"))
    low = lambda xs: F.coalesce(F.array_min(xs), F.lit(NOTHING))
    return F.struct(
        (F.size(new) - F.size(other)).alias("typos"), F.size(other).alias("others"), F.size(gone).alias("gone"), low(other).alias("other_min"),
        F.coalesce(F.array_max(other), F.lit(NOTHING)).alias("other_max"), low(F.transform(gone, lambda e: e["w"].cast("double"))).alias("gone_min"),
    )


def anchor_similarity(df: DataFrame, one: str, two: str, prefix: str = "anc") -> DataFrame:
    """Adds five comparisons of a record with its sibling: name ratio and token set, address token set, numbers shared, first number equal."""
    c = lambda side, x: F.coalesce(f"{side}{x}", F.lit(""))
    some = F.col(f"{two}name_core").isNotNull()
    n1, n2, d1, d2 = squash(c(one, "name_core")), squash(c(two, "name_core")), tokens(c(one, "nums")), tokens(c(two, "nums"))
    a1, a2 = c(one, "addr_norm"), c(two, "addr_norm")
    return df.select(
        "*", _or_nothing(some, ratio_udf(n1, n2)).alias(f"{prefix}_ratio"), _or_nothing(some, token_set_udf(n1, n2)).alias(f"{prefix}_set"),
        _or_nothing(some & (a1 != "") & (a2 != ""), token_set_udf(a1, a2)).alias(f"{prefix}_addr"), _or_nothing(some, jaccard(d1, d2)).alias(f"{prefix}_nums"),
        _or_nothing(some & (F.size(d1) > 0) & (F.size(d2) > 0), first(d1) == first(d2)).alias(f"{prefix}_first"),
    )


def pair_features(df: DataFrame) -> DataFrame:
    """Adds name, address, number and state features of each pair.

    Both sides need name_core, name_legal, addr_norm, nums, state, ph, acr, name and address; nulls
    count as empty. Only scalars are added, so the width of a row does not grow with its texts.
    """
    c = lambda side, x: F.coalesce(f"{side}_{x}", F.lit(""))
    a, b = squash(c("a", "name_core")), squash(c("b", "name_core"))
    glue = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    ga, gb, at, bt = glue(a), glue(b), tokens(a), tokens(b)
    aa, ba = c("a", "addr_norm"), c("b", "addr_norm")
    aat, bat, an, bn = tokens(aa), tokens(ba), tokens(c("a", "nums")), tokens(c("b", "nums"))
    addressed = ba != ""
    fa, fb, numbered = first(an), first(bn), (F.size(an) > 0) & (F.size(bn) > 0)
    codes = lambda xs: F.filter(xs, lambda d: F.char_length(d) >= 5)
    raw, pa, pb = c("b", "name"), c("a", "ph"), c("b", "ph")
    acr_a, acr_b, sounded = c("a", "acr"), c("b", "acr"), (pa != "") & (pb != "")
    shared = lambda xs, ys: F.size(F.array_intersect(xs, ys))
    distinct = lambda xs: F.size(F.array_distinct(xs))
    num = lambda x: x.cast("double")
    out = {
        "name_ratio": ratio_udf(a, b), "name_sort": token_sort_udf(a, b), "name_set": token_set_udf(a, b), "name_partial": partial_udf(a, b),
        "glued_jw": jaro_winkler_udf(ga, gb), "glued_ratio": ratio_udf(ga, gb), "glued_partial": _or_nothing(F.least(F.char_length(ga), F.char_length(gb)) >= 4, partial_udf(ga, gb)),
        "name_jac": jaccard(at, bt), "name_shared": num(shared(at, bt)), "name_size_gap": num(F.abs(distinct(at) - distinct(bt))),
        "name_len_a": num(F.char_length(a)), "name_len_b": num(F.char_length(b)), "name_equal": num(a == b), "glued_equal": num(ga == gb),
        "legal_jac": jaccard(tokens(c("a", "name_legal")), tokens(c("b", "name_legal"))), "legal_a": num(c("a", "name_legal") != ""), "legal_b": num(c("b", "name_legal") != ""),
        "non_latin_b": num(F.length(F.regexp_replace(raw, "[\\x00-\\u024F]", "")) > 0), "indic_b": num(non_latin(raw)), "site_b": num(raw.contains(".") & ~F.btrim(raw).contains(" ")),
        "addr_ratio": _or_nothing(addressed, ratio_udf(aa, ba)), "addr_set": _or_nothing(addressed, token_set_udf(aa, ba)), "addr_sort": _or_nothing(addressed, token_sort_udf(aa, ba)),
        "addr_partial": _or_nothing(addressed, partial_udf(aa, ba)), "addr_jac": _or_nothing(addressed, jaccard(aat, bat)), "addr_shared": num(shared(aat, bat)),
        "addr_size_b": num(distinct(bat)), "addr_empty_b": num((F.btrim(c("b", "address")) == "") | ~addressed),
        "num_jac": jaccard(an, bn), "num_shared": num(shared(an, bn)), "num_a": num(distinct(an)), "num_b": num(distinct(bn)), "num_first": _or_nothing(numbered, fa == fb),
        "num_subset": _or_nothing(F.size(bn) > 0, F.size(F.array_except(bn, an)) == 0), "num_code": _or_nothing((F.size(codes(an)) > 0) & (F.size(codes(bn)) > 0), F.arrays_overlap(codes(an), codes(bn))),
        "num_first_sim": _or_nothing(numbered, levenshtein_similarity(fa, fb)), "state_equal": _or_nothing((c("a", "state") != "") & (c("b", "state") != ""), c("a", "state") == c("b", "state")),
        "sound_ratio": _or_nothing(sounded, ratio_udf(glue(pa), glue(pb))), "sound_set": _or_nothing(sounded, token_set_udf(pa, pb)), "sound_sort": _or_nothing(sounded, token_sort_udf(pa, pb)),
        "acronym_b": num((acr_a != "") & (F.char_length(gb) <= 6) & ((gb == acr_a) | ((F.char_length(gb) >= 2) & acr_a.startswith(gb)))),
        "acronym_a": num((acr_b != "") & (F.char_length(ga) <= 6) & (ga == acr_b)), "addr_equal": _or_nothing((aa != "") & addressed, aa == ba),
    }
    return df.select("*", *(v.alias(k) for k, v in out.items()))


def weight_features(df: DataFrame) -> DataFrame:
    """Adds weighted overlaps of both directions and the alignment of names and addresses; needs a_ and b_ name_core, addr_norm, n_idf, a_idf."""
    c = lambda side, x: F.coalesce(f"{side}_{x}", F.lit(""))
    w = lambda x: F.coalesce(F.col(x).cast("array<double>"), F.array().cast("array<double>"))
    at, bt, aat, bat = tokens(squash(c("a", "name_core"))), tokens(squash(c("b", "name_core"))), tokens(c("a", "addr_norm")), tokens(c("b", "addr_norm"))
    both = (F.size(aat) > 0) & (F.size(bat) > 0)
    out = df.select(
        "*", idf_overlap(at, w("a_n_idf"), bt).alias("n_over_a"), idf_overlap(bt, w("b_n_idf"), at).alias("n_over_b"), idf_overlap(aat, w("a_a_idf"), bat).alias("a_over_a"),
        idf_overlap(bat, w("b_a_idf"), aat).alias("a_over_b"), align(at, bt, w("a_n_idf"), w("b_n_idf")).alias("n_aligned"),
        F.when(both, align(aat, bat, w("a_a_idf"), w("b_a_idf"))).alias("a_aligned"),
    )
    unknown = F.size(F.filter(w("b_n_idf"), lambda x: x >= UNSEEN)) / F.size(w("b_n_idf"))
    return out.withColumn("unknown_b", _or_nothing(F.size(w("b_n_idf")) > 0, unknown))
