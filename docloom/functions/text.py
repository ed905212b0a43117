"""Predicates and folds on text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that tell kinds of text apart.
LIST = r"^(?:[-*•‣▪◦]|\d+[.)]|[A-Za-z][.)])\s+"
SENTENCE_END = r"[.!?][\"')\]]*$"
SENTENCE_START = r"^[\"'(\[{]*[\p{Lu}\p{Lt}]"
NUMBERED = r"^\d+(?:\.\d+)*[.)]?\s+[\p{Lu}\p{Lt}]"
NO_SPACE_BEFORE = r"^[,.;:!?%)\]}]"
NO_SPACE_AFTER = r"[(\[{/]$"
WRAPPED = r"\p{L}{2,}-$"


def normal(text: Column) -> Column:
    """White space in a row is one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{a0}\x{feff}]+", " "))


def words(text: Column) -> Column:
    """Parts between blanks that hold a letter or a digit."""
    return F.filter(F.split(text, " "), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def is_list(text: Column) -> Column:
    return text.rlike(LIST)


def is_sentence(text: Column) -> Column:
    # Eight words and the blanks between are 15 characters: shorter texts need no search.
    return (F.length(text) >= 15) & (F.size(words(text)) >= 8) & (text.rlike(SENTENCE_END) | text.rlike(r"[,;]\s"))


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def begins_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_START)


def is_short_tail(text: Column) -> Column:
    return (F.length(text) <= 12) & ends_sentence(text)


def label_marks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))


def has_numbers(text: Column) -> Column:
    """Two numeric words, an amount or measure, or a leading number."""
    numeric = F.size(F.filter(F.split(text, " "), lambda w: w.rlike(r"^[(+-]?(?:\d[\d.,]*|[.,]\d+)[%)]?$")))
    return text.rlike(r"\d") & ((numeric >= 2) | text.rlike(r"(?i)[$€£¥]\s*\d|\d\s*(?:%|[$€£¥]|(?:mm|cm|kg|kw|kwh)\b)") | text.rlike(r"^\d{2,}\s+\S"))


def boundary_key(text: Column) -> Column:
    """Lower case with runs of digits as #, or null if too short or long."""
    key = F.regexp_replace(F.lower(text), r"\d+", "#")
    return F.when(F.length(key).between(3, 180), key)


def is_heading(text: Column, ratio: Column, index: Column, following: Column) -> Column:
    """Short, no sentence, and large, numbered, upper case, or in title case before body text."""
    own = words(text)
    n = F.size(own)
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}\p{Lt}\p{Lo}\p{Lm}]", ""))
    title = F.size(F.filter(own, lambda w: w.rlike(r"^[\p{Lu}\p{Lt}\d]"))) / n
    shape = (ratio >= 1.2) | text.rlike(NUMBERED) & (n <= 14) | (F.length(letters) > 0) & (upper / F.length(letters) >= 0.82) & (F.length(text) <= 90) | (title >= 0.72) & (n <= 10) & ((index <= 2) | F.coalesce(is_sentence(following), F.lit(False)) | (ratio > 1.05))
    return F.coalesce((F.length(text).between(1, 180)) & ~is_sentence(text) & n.between(1, 18) & ~((n <= 2) & ends_sentence(text)) & shape, F.lit(False))


def joined(texts: Column) -> Column:
    """Runs of one line: a blank between them unless a hyphen, a bracket or punctuation stands at the seam."""
    return F.aggregate(texts, F.lit(""), lambda acc, t: F.when(t == "", acc).when(acc == "", t).when(acc.endswith("-") | t.rlike(NO_SPACE_BEFORE) | acc.rlike(NO_SPACE_AFTER), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)))


def escape_markdown(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def roman(n: Column) -> Column:
    """Upper-case Roman numerals of 1 to 3999."""
    from .numerals import ROMAN

    out, rest = F.lit(""), n
    for value, letters in ROMAN:
        out = F.concat(out, F.repeat(F.lit(letters), F.floor(rest / value).cast("int")))
        rest = rest % value
    return out


def letters(n: Column) -> Column:
    """A to Z, then AA, BB, ..."""
    return F.repeat(F.char(F.lit(65) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
