"""Additive codes: loose form found inside a text, strict form of a whole value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provisor.functions.text import NEGATION

# Code patterns, and the Cyrillic suffix letters with their Latin reading.
CODE_IN_TEXT = (
    r"(?iU)(?<!\w)[eе][\s-]?(\d{3,4}[a-zа-я]?)(\s*\([ivx]+\))?(?!\w|\s*\([ivx])"
)
STRICT_CODE = r"(?U)^E\d{3,4}[A-Z]?(?:\([IVX]+\))?$"
CODE_LIKE = r"(?i)^[eе][\s-]*\d{3,4}[a-z]*(?:\([ivx]+\))?$"
SUFFIX_CYRILLIC, SUFFIX_LATIN = "абвс", "abbc"


def code_text(text: Column) -> Column:
    """Code as written in a text that is not negated; empty or null when there is none.

    The case-insensitive pattern only runs on texts with three digits in a row.
    """
    return F.when(text.rlike(r"(?U)\d{3}") & ~text.rlike(NEGATION), F.regexp_extract(text, CODE_IN_TEXT, 0))


def code_form(found: Column) -> Column:
    """Normal form of a code as written: ``E<digits><suffix>(<subtype>)``."""
    bare = F.lower(F.substr(F.regexp_replace(found, r"(?U)[\s-]+", ""), F.lit(2)))
    return F.when(found != "", F.concat(F.lit("E"), F.translate(bare, SUFFIX_CYRILLIC, SUFFIX_LATIN)))


def first_code(text: Column) -> Column:
    """First code in a text in its normal form with lower-case suffixes, else null."""
    return code_form(F.when(text.rlike(r"(?U)\d{3}"), F.regexp_extract(text, CODE_IN_TEXT, 0)))


def _compact(text: Column) -> Column:
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s-]", "")
    return F.translate(F.upper(squeezed), "Е", "E")


def strict_code(text: Column) -> Column:
    """Upper-case code when the whole value is one code, else null."""
    compact = _compact(text)
    return F.when(compact.rlike(STRICT_CODE), compact)


def code_lists(values: Column) -> Column:
    """Struct of the sorted distinct codes of a list and the values which are no codes."""
    codes = F.transform(values, strict_code)
    return F.struct(
        F.array_sort(F.array_distinct(F.filter(codes, lambda c: c.isNotNull()))).alias("codes"),
        F.filter(values, lambda v: strict_code(v).isNull()).alias("rejected"),
    )


def is_code_like(text: Column) -> Column:
    return text.rlike(CODE_LIKE)


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def code_spellings(code: Column) -> Column:
    """The code as written with a Cyrillic letter, a dash and a space, without repeats."""
    rest = F.substr(code, F.lit(2))
    return F.array_distinct(F.array(
        code,
        F.concat(F.lit("Е"), rest),
        F.concat(F.lit("E-"), rest),
        F.concat(F.lit("E "), rest),
    ))
