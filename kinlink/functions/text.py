"""Normalisation of names and addresses.

All but other scripts stays in the JVM: accents, states, squashing, sound keys, look-alike digits,
abbreviations, numbers. Transliteration, which needs Unicode's tables, is an Arrow UDF for rows that
have other letters than Latin ones.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..memo import memo
from .scripts import BREAK, LETTER, NASAL, plain_letters, script_table, spoken
from .tables import ADDRESS_ABBR, CHILLU, FRENCH, IN_STATES, LATIN, LEGAL, LEGAL_SOUND, NAME_ABBR, NULL_TOKENS, SOUNDS, US_STATES, VOWELS

DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|in|co|net|org|fr|biz|info)(?:\.[a-z]{2})?$"
STATES = {**US_STATES, **IN_STATES}
FRENCH_CODE = {name: code for code, names in FRENCH.items() for name in names}
LOOK_ALIKE = ("01358", "olesb")


# ---- native expressions over ASCII text


def squash(x: Column) -> Column:
    """Runs of one character become one; digits too."""
    return F.regexp_replace(x, r"(.)\1+", "$1")


def phonetic(x: Column) -> Column:
    """Sound key of a lower-case ASCII word: digraphs folded, voiced and unvoiced merged, vowels after the first letter dropped."""
    w = F.regexp_replace(x, "[^a-z]", "")
    for a, b in (("ph", "f"), ("sh", "s"), ("ch", "s"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("dh", "d"), ("bh", "b"), ("jh", "j"), ("ck", "k"), ("x", "ks")):
        w = F.replace(w, F.lit(a), F.lit(b))
    w = F.translate(w, "cqgbdwzf", "kkkptvjp")
    rest = F.regexp_replace(F.substring(w, F.lit(2), F.greatest(F.char_length(w), F.lit(1))), "[aeiouyh]", "")
    return squash(F.concat(F.substring(w, 1, 1), rest))


#: Letters whose capital in the SQL is one letter or none, where Java's is several or newer: ligatures and Greek with signs, Unicode 16.
_SEVERAL = [c for c in map(chr, range(0x80, 0xFB20)) if len(c.upper()) > 1]
_NEWER = [chr(c) for c in (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86))]
CAPITALS = {**{c: c.title() if len(c.title()) == 1 else c for c in _SEVERAL}, **{c: c for c in _NEWER}, "\u00df": "\u1e9e"}


def capital(letter: Column) -> Column:
    """The capital of one letter as one letter: ẞ for ß, and itself where it has none."""
    return F.when(F.instr(F.lit("".join(CAPITALS)), letter) > 0, F.translate(letter, "".join(CAPITALS), "".join(CAPITALS.values()))).otherwise(F.upper(letter))


def fix_look_alikes(tok: Column) -> Column:
    """Digits that look like letters, in words that mix both and have two letters or more."""
    mixed = tok.rlike("[0-9]") & (F.char_length(F.regexp_replace(tok, "[^a-z]", "")) >= 2)
    return F.when(mixed, F.translate(tok, *LOOK_ALIKE)).otherwise(tok)


def mapped(tok: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), tok), tok)


def words(x: Column) -> Column:
    """Words of letters and digits of an ASCII text, without the empty one that splitting '' gives."""
    return F.filter(F.split(F.regexp_replace(x, "[^a-z0-9 ]+", " "), " +"), lambda t: t != "")


def name_parts(ascii_name: Column) -> Column:
    """struct(core, legal): tokens of a transliterated name; a web address is one glued token."""
    s = F.btrim(ascii_name)
    glued = F.replace(s, F.lit(" "), F.lit(""))
    domain = F.replace(F.regexp_extract(glued, DOMAIN, 1), F.lit("-"), F.lit(""))
    for a, b in (("&", " and "), ("+", " and "), ("@", " "), ("m/s", " ms "), ("pvt.", "pvt "), ("'", "")):
        s = F.replace(s, F.lit(a), F.lit(b))
    toks = F.transform(words(s), lambda t: mapped(fix_look_alikes(t), NAME_ABBR))
    legal = lambda t: t.isin(*sorted(LEGAL)) | ((F.char_length(t) >= 5) & ~t.rlike("^[0-9]+$") & phonetic(t).isin(*sorted(LEGAL_SOUND)))
    none = F.array().cast("array<string>")
    site = glued.rlike(DOMAIN)
    return F.struct(F.when(site, F.array(domain)).otherwise(F.filter(toks, lambda t: ~legal(t))).alias("core"), F.when(site, none).otherwise(F.filter(toks, legal)).alias("legal"))


def address_words(ascii_address: Column) -> Column:
    """Address tokens, abbreviations mapped once; a token may map to two words or to none."""
    toks = words(F.replace(F.replace(ascii_address, F.lit("#"), F.lit(" ")), F.lit("'"), F.lit(" ")))
    toks = F.transform(F.filter(toks, lambda t: ~t.isin(*sorted(NULL_TOKENS))), lambda t: mapped(t, ADDRESS_ABBR))
    return F.filter(toks, lambda t: t != "")


def numbers(toks: Column) -> Column:
    """Runs of digits without leading zeros ('0' stays), each once, in order."""
    runs = F.flatten(F.transform(toks, lambda t: F.regexp_extract_all(t, F.lit("([0-9]+)"))))
    return F.array_distinct(F.transform(runs, lambda d: F.regexp_replace(d, "^0+(?=[0-9])", "")))


def glued_numbers(toks: Column) -> Column:
    """All digits of a token in one, without leading zeros; tokens of zeros only go; repeats stay."""
    return F.filter(F.transform(toks, lambda t: F.regexp_replace(F.regexp_replace(t, "[^0-9]", ""), "^0+", "")), lambda d: d != "")


def acronym(toks: Column) -> Column:
    """Initials, if there are two tokens or more and all are letters."""
    a = F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), "")
    return F.when((F.size(toks) >= 2) & a.rlike("^[a-z]+$"), a).otherwise(F.lit(""))


def sound_keys(toks: Column) -> Column:
    """Sound keys of the tokens of letters, joined by spaces."""
    return F.array_join(F.transform(F.filter(toks, lambda t: t.rlike("^[a-z]+$")), phonetic), " ")


def non_latin(x: Column) -> Column:
    return F.coalesce(x.rlike("[\\u0900-\\u0DFF]"), F.lit(False))


# ---- other scripts and accents


@memo
def _table() -> dict[int, str]:
    """Code points of Indic scripts and special Latin letters; characters without a width go."""
    signs = {
        "SIGN CANDRABINDU": LETTER + "n", "SIGN ADAK BINDI": LETTER + "n", "SIGN ANUSVARA": LETTER + NASAL, "SIGN BINDI": LETTER + NASAL, "SIGN VISARGA": LETTER + "h",
        "SIGN VIRAMA": BREAK, "SIGN NUKTA": "", "LENGTH MARK": BREAK, "AI LENGTH MARK": BREAK, "AU LENGTH MARK": BREAK + "u",
    }
    letters = script_table(SOUNDS, VOWELS, signs, vowel="", digit=LETTER, finals=CHILLU)
    return {**letters, **{ord(a): b for a, b in LATIN.items()}, **dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF), "")}


#: A nasal sign before a letter that is no p, b or m; any other is an m.
BEFORE_OTHERS = re.compile(f"{NASAL}(?={LETTER}?[a-z])(?!{LETTER}?[pbm])")
#: Malayalam's doubled rra is spoken as doubled tta.
RRA, TTA = "\u0d31\u0d4d\u0d31", "\u0d1f\u0d4d\u0d1f"


def to_ascii(text: str | None) -> str:
    """Lower-case ASCII: accents go, nine Indic scripts are spelled by sound, other scripts are dropped.

    A consonant carries an inherent a before another consonant or sign, not before a vowel letter and not at the end of a word.
    """
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    whole = unicodedata.normalize("NFC", text)
    known = whole.replace(RRA, TTA).translate(_table()).lower()
    known = spoken(BEFORE_OTHERS.sub("n", known).replace(NASAL, "m"))
    if known.isascii():
        return known
    return "".join(c for c in unicodedata.normalize("NFKD", known) if c.isascii())


@F.pandas_udf(T.StringType())
def ascii_udf(x):
    return x.map(to_ascii)


#: Latin letters and marks that native functions bring to ASCII in full.
LATIN_ONLY = "^[\\x00-\\x7F\\u00C0-\\u024F\\u1E00-\\u1EFF\\u2018\\u2019\\u201C\\u201D\\u2013\\u2014\\u00B4]*$"


def latin_to_ascii(x: Column) -> Column:
    """Lower-case ASCII of text of Latin letters; what has no base letter goes."""
    out = F.lower(x)
    for a, b in LATIN.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.lower(F.translate(out, *plain_letters())), "[^\\x00-\\x7F]", "")


def to_ascii_col(x: Column) -> Column:
    """Transliteration; only rows with other letters than Latin ones leave the JVM."""
    return F.when(x.isNull(), F.lit("")).when(x.rlike("^[\\x00-\\x7F]*$"), F.lower(x)).when(x.rlike(LATIN_ONLY), latin_to_ascii(x)).otherwise(ascii_udf(x))


@memo
def _state_pattern() -> str:
    return "(?iU)(?<!\\w)(" + "|".join(sorted(STATES, key=lambda n: (-len(n), n))) + ")(?!\\w)"


def split_state(address: Column) -> Column:
    """struct(rest, state): state names anywhere, codes and French regions as whole parts between commas; the last one found wins, parts over names."""
    table = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    names, regions = table(STATES), table({**{c: c for c in sorted(set(STATES.values()))}})
    french = table(FRENCH_CODE)
    whole = F.coalesce(address, F.lit(""))
    parts = F.split(F.regexp_replace(whole, _state_pattern(), " "), ",")
    region = lambda p: F.btrim(F.regexp_replace(latin_to_ascii(p), "[^a-z]+", " "))
    code = lambda p: F.coalesce(F.element_at(regions, F.lower(F.btrim(p))), F.element_at(french, region(p)))
    short = lambda p: F.char_length(p) <= LONGEST_PART
    own = F.filter(F.transform(parts, lambda p: F.when(short(p), code(p))), lambda c: c.isNotNull())
    rest = F.array_join(F.filter(parts, lambda p: ~short(p) | code(p).isNull()), ",")
    said = F.transform(F.regexp_extract_all(whole, F.lit(_state_pattern()), F.lit(1)), lambda n: F.coalesce(F.element_at(names, F.lower(n)), F.element_at(names, n)))
    found = F.when(F.size(own) > 0, F.element_at(own, -1)).when(F.size(said) > 0, F.element_at(said, -1)).otherwise(F.lit(""))
    return F.struct(rest.alias("rest"), F.coalesce(found, F.lit("")).alias("state"))


#: Characters that a part with a code or a region name can have, with blanks and marks around it.
LONGEST_PART = 80


def normalise(records, name: str = "name", address: str = "address"):
    """Adds name_core, name_legal, addr_norm, nums, state, ph, acr to records; nulls count as empty."""
    out = records.withColumn("_n", name_parts(to_ascii_col(F.col(name)))).withColumn("_s", split_state(F.col(address)))
    out = out.withColumn("_a", address_words(to_ascii_col(F.col("_s.rest"))))
    j = lambda x: F.array_join(x, " ")
    return out.select(
        *records.columns, j(F.col("_n.core")).alias("name_core"), j(F.col("_n.legal")).alias("name_legal"), j(F.col("_a")).alias("addr_norm"),
        j(numbers(F.col("_a"))).alias("nums"), F.col("_s.state").alias("state"), sound_keys(F.col("_n.core")).alias("ph"), acronym(F.col("_n.core")).alias("acr"),
    )
