"""Indic scripts in Latin letters: one table of code points, built from Unicode's names, and one rule for the inherent vowel.

Every character of the nine Brahmic scripts is written as its Latin letters and marks: LETTER before
what makes a consonant in front of it speak its inherent vowel, INHERENT after a consonant, BREAK where
a sign takes that vowel away. A string is translated once; an INHERENT directly before a LETTER becomes
an a, and the marks go. At the end of a word nothing follows, so the vowel is not spoken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping

SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
FIRST, LAST = 0x900, 0xD7F
LETTER, INHERENT, BREAK, NASAL = "\x01", "\x02", "\x03", "\x04"
SPOKEN = re.compile(f"{INHERENT}(?={LETTER})")
MARKS = re.compile(f"[{LETTER}{INHERENT}{BREAK}]")


def script_table(
    sounds: Mapping[str, str], vowels: Mapping[str, str], signs: Mapping[str, str], *, vowel: str, digit: str, finals: Mapping[str, str] | None = None, spaced: bool = False
) -> dict[int, str]:
    """What stands for each code point of the scripts, by the part of its name behind the script's.

    ``sounds``: consonants by name in lower case without blanks, if their sound is not that without its last a;
    ``vowels``: vowels by name, as letters and signs; ``signs``: other signs; ``finals``: Malayalam's final
    consonants. ``vowel`` and ``digit``: the marks before vowel letters and digits. What nothing names is a
    blank, as is a consonant with blanks in its name unless ``spaced``.
    """

    def of(name: str, ch: str) -> str:
        if name in signs:
            return signs[name]
        head, _, rest = name.partition("LETTER ")
        if name.startswith("VOWEL SIGN "):
            return BREAK + vowels.get(name[11:], "")
        if name.startswith("DIGIT "):
            return digit + str(unicodedata.digit(ch))
        if head or not rest:
            return " "
        if rest in vowels:
            return vowel + vowels[rest]
        if rest.startswith("CHILLU "):
            final = rest[7:]
            return LETTER + (finals[final] if finals and final in finals else sounds.get(final.lower() + "a", final.lower()))
        plain = rest.lower().replace(" ", "")
        if plain not in sounds and " " in rest and not spaced:
            return " "
        return LETTER + sounds.get(plain, plain.removesuffix("a")) + INHERENT

    names = ((code, unicodedata.name(chr(code), "").partition(" ")) for code in range(FIRST, LAST + 1))
    return {code: of(name, chr(code)) for code, (script, _, name) in names if script in SCRIPTS}


def spoken(text: str) -> str:
    """A translated text with its inherent vowels, without marks other than NASAL."""
    return MARKS.sub("", SPOKEN.sub("a", text))


def plain_letters() -> tuple[str, str]:
    """Latin letters with accents and the letters without, one for one, for a native translate."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
