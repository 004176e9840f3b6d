"""Tokenisers and stemmers by language, with a default for all others.

``TOKENIZERS`` and ``STEMMERS`` are open: put a function of a Column under a
language to use it everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.text import spaced_ideographs, tokens

# The inflectional suffixes of Hindi after Ramanathan and Rao, "A lightweight stemmer for Hindi".
HINDI_SUFFIXES = """
ो े ू ु ी ि ा
कर ाओ िए ाई ाए ने नी ना ते ीं ती ता ाँ ां ों ें
ाकर ाइए ाईं ाया ेगी ेगा ोगी ोगे ाने ाना ाते ाती ाता तीं ाओं ाएं ुओं ुएं ुआं
ाएगी ाएगा ाओगी ाओगे एंगी ेंगी एंगे ेंगे ूंगी ूंगा ातीं नाओं नाएं ताओं ताएं ियाँ ियों ियां
ाएंगी ाएंगे ाऊंगी ाऊंगा ाइयाँ ाइयों ाइयां
""".split()


def hindi_stem(word: Column) -> Column:
    """Without its longest suffix, if at least two characters more than the suffix are there."""
    out = word
    for size in sorted({len(s) for s in HINDI_SUFFIXES}):  # the longest is asked last, and so decides first
        known = [s for s in HINDI_SUFFIXES if len(s) == size]
        fits = (F.length(word) > size + 1) & F.substring(word, -size, size).isin(known)
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - size)).otherwise(out)
    return out


# Burmese vowel and consonant signs, which depend on the letter before, the asat that silences a letter, and the sign that stacks letters.
DEPENDENT, ASAT, STACK = r"\x{102B}-\x{1032}\x{1036}-\x{1038}\x{103B}-\x{103E}\x{103A}", "\u103a", "\u1039"


def burmese_syllables(text: Column) -> Column:
    """Letters with their dependent signs; a silenced letter (of fewer than four characters) closes the syllable before it, and stacked letters are one.

    White space counts for nothing, nor do joiners.
    """
    swapped = F.replace(F.replace(text, F.lit("\u200c"), F.lit(" ")), F.lit("\u1037" + ASAT), F.lit(ASAT + "\u1037"))
    bare = F.regexp_replace(F.lower(swapped), r"[\s\p{Z}]+", "")
    sign = f"[{DEPENDENT}]"
    silenced = rf".(?:{ASAT}{sign}?|{sign}{ASAT})(?!{sign})"
    unit = rf"(?s)((?:^{silenced}|(?!{silenced}).{sign}*)(?:{silenced})?|{silenced})"
    units = F.array_join(F.regexp_extract_all(bare, F.lit(unit), F.lit(1)), " ")
    return F.filter(F.split(F.replace(units, F.lit(f" {STACK} "), F.lit(STACK)), " "), lambda x: x != "")


def ideograph_tokens(text: Column) -> Column:
    """Every ideograph by itself, other text as words."""
    return tokens(spaced_ideographs(text))


def characters(text: Column) -> Column:
    """Letters one by one, with the marks that belong to them: for scripts without spaces where no dictionary is at hand."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]\p{M}*)"), F.lit(1))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "my": burmese_syllables,
    "zh": ideograph_tokens,
    "ja": ideograph_tokens,
    "th": characters,
    "lo": characters,
    "km": characters,
}
STEMMERS: dict[str, Callable[[Column], Column]] = {"hi": hindi_stem}


def tokenize(text: Column, language: str, stem: bool = False) -> Column:
    """Lower-case tokens of a text in a language, without empty ones, stemmed on demand."""
    found = TOKENIZERS.get(language, tokens)(text)
    stemmer = STEMMERS.get(language)
    return F.filter(F.transform(found, stemmer), lambda x: x != "") if stem and stemmer else found
