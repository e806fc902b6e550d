"""Similarity of two strings, token lists or number lists.

Set and number features and Levenshtein are native expressions; the Arrow UDFs at the end compute the
family of Indel ratios in batches, a pair of strings once each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct tokens; -1 if there are none."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def idf_overlap(toks: Column, idf: Column, other: Column) -> Column:
    """struct(share, top_shared, top_missing) of weights of the tokens that the other side has; repeats count once; -1 without weight."""
    z = F.arrays_zip(toks.alias("t"), idf.alias("w"), F.transform(toks, lambda t: F.array_position(toks, t)).alias("f"), F.transform(toks, lambda t, i: i + 1).alias("i"))
    z = F.filter(z, lambda e: e["f"] == e["i"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, e: s + e["w"].cast("double"))
    top = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda e: e["w"].cast("double"))), F.lit(0.0))
    here, gone = F.filter(z, lambda e: F.array_contains(other, e["t"])), F.filter(z, lambda e: ~F.array_contains(other, e["t"]))
    return F.struct(F.when(total(z) > 0, total(here) / total(z)).otherwise(F.lit(-1.0)).alias("share"), top(here).alias("top_shared"), top(gone).alias("top_missing"))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def number_features(a: Column, b: Column) -> Column:
    """First equal, one side inside the other, codes of five digits shared, fewest edits between any two, numbers missing."""
    inside = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    long = lambda x: F.filter(x, lambda d: F.char_length(d) >= 5)
    edits = F.array_min(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.levenshtein(x, y)))))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    flag = lambda c: F.when(some, c.cast("int")).otherwise(F.lit(-1))
    return F.struct(
        flag(F.get(a, F.lit(0)) == F.get(b, F.lit(0))).alias("first_equal"), flag(inside).alias("subset"),
        F.when((F.size(long(a)) > 0) & (F.size(long(b)) > 0), F.arrays_overlap(long(a), long(b)).cast("int")).otherwise(F.lit(-1)).alias("code_equal"),
        F.coalesce(edits, F.lit(9)).alias("min_edits"), F.size(F.array_except(a, b)).alias("missing"),
    )


def acronym_match(acr: Column, glued: Column) -> Column:
    """Whether the acronym of one side begins with the glued name of the other."""
    return (F.char_length(glued) >= 2) & acr.startswith(glued)


def is_abbreviation(short: Column, long: Column) -> Column:
    """Same first letter, and the short word's letters occur in order in the long one."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*"))
    return (F.char_length(short) > 0) & short.rlike("^[a-z0-9]+$") & F.rlike(long, pattern)


# ---- ratios, a batch at a time


def lcs_length(a: str, b: str) -> int:
    """Length of a longest common subsequence, one big integer as the row of bits."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / n if n else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among shared tokens, and shared tokens with each side's own; 0 if a side is empty."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with any window of its length in the longer one, cut at its ends."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a:
        return 100.0 if not b else 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four equal first characters if above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return j + same * 0.1 * (1 - j) if j > 0.7 else j


def _udf(f):
    @F.pandas_udf(T.DoubleType())
    def both(a, b):
        import numpy as np
        import pandas as pd

        pairs = pd.MultiIndex.from_arrays([a.fillna(""), b.fillna("")])
        code, known = pairs.factorize()  # equal pairs of a batch are computed once
        return pd.Series(np.array([f(x, y) for x, y in known], dtype=float)[code] if len(known) else [], dtype=float)

    return both


def ratio_udf(a, b):
    return _udf(ratio)(a, b)


def token_sort_udf(a, b):
    return _udf(token_sort_ratio)(a, b)


def token_set_udf(a, b):
    return _udf(token_set_ratio)(a, b)


def partial_udf(a, b):
    return _udf(partial_ratio)(a, b)


def jaro_winkler_udf(a, b):
    return _udf(jaro_winkler)(a, b)
