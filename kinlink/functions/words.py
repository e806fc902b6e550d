"""The second normalisation: words and digits of any script, and the parts that its features compare.

Text of Latin letters never leaves the JVM. Other scripts are spelled in an Arrow UDF by one table of
code points; the rest, look-alike digits in words included, is native.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..memo import memo
from .scripts import BREAK, LETTER, plain_letters, script_table, spoken
from .tables import LOOK_ALIKE_BEFORE, LOOK_ALIKE_INSIDE, SOUNDS_SECOND, VOWELS_SECOND, WEB
from .text import glued_numbers

#: Characters without a width, which go.
INVISIBLE = "[\\u200B-\\u200F\\u2060\\uFEFF]"
#: Text that native functions bring to plain letters in full.
LATIN_ONLY = "^[\\x00-\\x7F\\u00C0-\\u024F\\u1E00-\\u1EFF\\u200B-\\u200F\\u2060\\uFEFF\\u2018\\u2019\\u201C\\u201D\\u2013\\u2014]*$"


@memo
def _table() -> dict[int, str]:
    nasal = dict.fromkeys(("SIGN ANUSVARA", "SIGN CANDRABINDU", "SIGN INVERTED CANDRABINDU", "SIGN TIPPI", "SIGN BINDI", "TIPPI"), LETTER + "n")
    nothing = dict.fromkeys(("SIGN NUKTA", "AI LENGTH MARK", "AU LENGTH MARK", "ADDAK", "SIGN ADDAK"), "")
    signs = {**nasal, **nothing, "SIGN VISARGA": LETTER + "h", "SIGN VIRAMA": BREAK}
    return script_table(SOUNDS_SECOND, VOWELS_SECOND, signs, vowel=LETTER, digit="", spaced=True)


def spell(text: str | None) -> str:
    """Compatibility forms resolved, Indic letters in Latin ones, accents gone."""
    known = spoken(unicodedata.normalize("NFKC", text or "").translate(_table()))
    return "".join(c for c in unicodedata.normalize("NFKD", known) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def spell_udf(x):
    return x.map(spell)


def letters_for_digits(text: Column) -> Column:
    """Look-alike digits as letters: runs of them between letters, and one before a word of three letters and more."""
    run = "".join(LOOK_ALIKE_INSIDE)
    out = text
    for digit, letter in LOOK_ALIKE_INSIDE.items():
        out = F.regexp_replace(out, f"(?<=[a-z][{run}]{{0,99}}){digit}(?=[{run}]*+[a-z])", letter)
    for digit in LOOK_ALIKE_BEFORE:
        out = F.regexp_replace(out, f"\\b{digit}(?=[a-z]{{3}})", LOOK_ALIKE_INSIDE[digit])
    return F.when(text.rlike("[0-9][a-z]"), out).otherwise(text)


def clean(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space between them; null counts as empty."""
    whole = F.replace(F.coalesce(text, F.lit("")), F.lit("<NULL>"), F.lit(" "))
    latin = F.translate(whole, *plain_letters())
    plain = F.when(whole.rlike("^[\\x00-\\x7F]*$"), whole).when(whole.rlike(LATIN_ONLY), latin).otherwise(spell_udf(F.regexp_replace(whole, INVISIBLE, "")))
    plain = F.lower(F.regexp_replace(plain, INVISIBLE, ""))
    plain = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), "(?<=[a-z])['\u2019`](?=[a-z])", "")
    return F.btrim(letters_for_digits(F.regexp_replace(plain, "[^0-9a-z]+", " ")))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def name_of(cleaned: Column) -> Column:
    """A cleaned name without numbers of seven digits and more."""
    return F.array_join(F.filter(tokens(cleaned), lambda t: ~t.rlike("^[0-9]{7,}$")), " ")


def address_only_words(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.rlike("[0-9]"))


def core_tokens(toks: Column, common: Column) -> Column:
    """Name words that are neither of the web nor common in the country; the common ones too if nothing else is left."""
    own = F.filter(toks, lambda t: ~t.isin(*WEB))
    rare = F.filter(own, lambda t: ~F.array_contains(common, t))
    return F.when(F.size(rare) > 0, rare).otherwise(own)


def crossed(core: Column, words: Column, nums: Column) -> Column:
    """Marked blocking tokens: n: name words, a: address words, d: numbers, j: the glued name, and x: y: c: pairs of them.

    The first 4, 8 and 3 of each take part, words of two letters and more; c: pairs 3 with 6.
    """
    long = lambda xs, k: F.slice(F.filter(xs, lambda t: F.char_length(t) > 1), 1, k)
    n, a, d = long(core, 4), long(words, 8), F.slice(nums, 1, 3)
    mark = lambda m, xs: F.transform(xs, lambda t: F.concat(F.lit(m), t))
    cross = lambda m, xs, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.concat(F.lit(m), x, F.lit("_"), y))))
    glued = F.array_join(core, "")
    joined = F.when(F.char_length(glued) >= 4, F.array(F.concat(F.lit("j:"), glued))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(mark("n:", n), mark("a:", a), mark("d:", d), joined, cross("x:", d, a), cross("y:", n, d), cross("c:", F.slice(n, 1, 3), F.slice(a, 1, 6))))


def second_form(records, name: str = "name", address: str = "address"):
    """Adds name2, addr2 (cleaned text), nums2 and words2 (token lists); nulls count as empty."""
    out = records.withColumn("name2", name_of(clean(F.col(name)))).withColumn("addr2", clean(F.col(address)))
    return out.withColumn("nums2", glued_numbers(tokens(F.col("addr2")))).withColumn("words2", address_only_words(tokens(F.col("addr2"))))
