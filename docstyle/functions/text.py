"""Column functions over texts: tokens, words, chunks, sentences, punctuation. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: a run of letters, digits and underscores, or any other single character that isn't white space (of which SQL's
#: expressions know five; Java's also take the vertical tab).
TOKEN = r"[\p{L}\p{N}_]+|[^\t\n\f\r \p{L}\p{N}_]"
#: A sentence's end, with closing quotes and brackets.
SENTENCE_END = r"""[.!?]["')\]]*"""
#: What each rate counts; non-overlapping, per thousand characters.
MARKS = {
    "comma_rate": [","], "semicolon_rate": [";"], "colon_rate": [":"], "dash_rate": ["—", "–", " - "], "exclamation_rate": ["!"],
    "question_rate": ["?"], "parenthesis_rate": ["("], "quotation_rate": ['"', "“", "”"], "ellipsis_rate": ["…", "..."],
}


def lower(text: Column) -> Column:
    """In lower case by single characters, as SQL does it: Java makes two of a dotted capital I, and a final sigma."""
    return F.lower(F.replace(F.replace(text, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(lower(text), F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, most: int = 999_999) -> Column:
    return F.substring(text, 1, most)


def count_of(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a substring."""
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def punctuation(text: Column) -> dict[str, Column]:
    """Rates per thousand characters; null for a null or empty text."""
    out = {}
    for name, parts in MARKS.items():
        total = count_of(text, parts[0])
        for p in parts[1:]:
            total = total + count_of(text, p)
        out[name] = F.when(F.length(text) > 0, total * F.lit(1000.0) / F.length(text))
    return out


def all_caps_words(text: Column) -> Column:
    """Words of more than one character that have a cased character and no lower-case one."""
    return F.size(F.filter(words(text), lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)))


def all_caps_rate(text: Column) -> Column:
    """All-capital words by tokens; NaN for a text without tokens (as 0 / 0 in SQL), null for a null text."""
    n = F.size(tokens(text))
    return F.when(n > 0, F.try_divide(all_caps_words(text), n)).when(n == 0, F.lit(float("nan")))


def chunks(text: Column, size: int = 100, overlap: int = 3) -> Column:
    """Runs of `size` words that begin every size - overlap words; none of an empty text."""
    step, w = max(1, size - overlap), words(text)
    starts = F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))
    return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Pieces between sentence ends that hold more than white space."""
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.length(F.trim(F.regexp_replace(s, r"\s+", " "))) > 0)


def syllables(word: Column) -> Column:
    """Groups of vowels, one at least: a stand-in for a hyphenation dictionary."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(word, F.lit("[aeiouy]+"), F.lit(0))))


def after_marker(prompt: Column, marker: str = "PASSAGE:") -> Column:
    """What follows the first marker, stripped; all of it, stripped, without one."""
    at = F.instr(prompt, marker)
    return strip(F.when(at > 0, F.substring(prompt, at + F.lit(len(marker)), F.length(prompt))).otherwise(prompt))
