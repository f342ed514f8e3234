"""Column functions with the number and text semantics of a JavaScript auditor."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode-aware white space for Java regexes.
SPACES = r"(?U)\s+"


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half goes towards plus infinity, as a double."""
    f = float(10**digits)
    return F.floor(x * f + 0.5) / F.lit(f)


def number_text(x: Column) -> Column:
    """A number as text: no decimals if it is whole."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def fixed1(x: float) -> str:
    """One decimal; ties of the exact binary value go up."""
    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """White space runs become one space, ends are cut."""
    return F.trim(F.regexp_replace(x, SPACES, " "))


def empty(x: Column) -> Column:
    """Falsy text: null or ''."""
    return F.coalesce(x, F.lit("")) == ""


def words(text: Column) -> Column:
    """Words of squeezed text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def syllables(word: Column) -> Column:
    """Vowel groups of at most two letters, without a silent ending; short words have one."""
    w = F.regexp_replace(F.lower(word), "[^a-z]", "")
    stem = F.regexp_replace(w, "([^laeiouy]es|ed|[^laeiouy]e)$", "")
    return F.when(F.length(w) == 0, 0).when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(stem, F.lit("[aeiouy]{1,2}"))))


def syllables_of(text: Column) -> Column:
    """Sum of syllables() over words between spaces, by a few passes over the whole text; 0 for null."""
    low = F.regexp_replace(F.lower(text), "[^a-z ]+", "")
    # a short word counts as one vowel would; so does a stem of consonants
    stems = F.regexp_replace(F.regexp_replace(low, r"\b[a-z]{1,3}\b", "a"), r"(?:[^laeiouy ]es|ed|[^laeiouy ]e)\b", "")
    return F.coalesce(F.regexp_count(stems, F.lit(r"[aeiouy]{1,2}|\b[^aeiouy ]+\b")), F.lit(0))


def sentences(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit("[.!?]+")))


def reading_level(text: Column, word_list: Column, syllable_count: Column | None = None) -> Column:
    """Flesch-Kincaid grade, one decimal, 0 at least; 0 without words. syllable_count: syllables_of(text) where a column holds it."""
    counted = syllables_of(text) if syllable_count is None else syllable_count
    n = F.size(word_list)
    grade = F.lit(0.39) * (n / sentences(text)) + F.lit(11.8) * (counted / n) - F.lit(15.59)
    return F.when(n > 0, F.greatest(F.lit(0.0), round_half_up(grade, 1))).otherwise(F.lit(0.0))


# Languages in order of preference and the words that mark them.
LANGUAGE_WORDS = {
    "English": [" the ", " and ", " of ", " to ", " is ", " in "],
    "Spanish": [" el ", " la ", " de ", " que ", " y ", " los "],
    "French": [" le ", " la ", " les ", " des ", " et ", " une "],
    "German": [" der ", " die ", " und ", " den ", " ist ", " das "],
}


def detect_language(text: Column, sample: int = 5000, least: int = 2) -> Column:
    """Language whose marking words are most frequent in the first characters; ties go to the first, few hits to Unknown."""
    part = F.substring(F.lower(text), 1, sample)
    scores = [sum((F.size(F.split(part, w, -1)) - 1 for w in ws[1:]), F.size(F.split(part, ws[0], -1)) - 1) for ws in LANGUAGE_WORDS.values()]
    best = F.greatest(*scores)
    out = F.lit("Unknown")
    for name, score in reversed(list(zip(LANGUAGE_WORDS, scores, strict=True))):
        out = F.when(score == best, name).otherwise(out)
    return F.when(best > least, out).otherwise("Unknown")


def html_kb(html: Column) -> Column:
    return round_half_up(F.octet_length(html) / 1024, 1)


def text_ratio(text: Column, html: Column) -> Column:
    size = F.octet_length(html)
    return F.when(size > 0, round_half_up(F.length(text) / size * 100, 1)).otherwise(F.lit(0.0))
