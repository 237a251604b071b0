"""Label text: normal form, token splitting, small cleaners."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from provisor.session import ship

# Characters whose compatibility form and case folding equal plain lower-casing,
# so the JVM expression is exact for a text made of them (checked character by character in
# the tests). All other texts take the Arrow path.
SIMPLE_CHARS = (
    r"\x09-\x0d\x20-\x7e"                              # ASCII without control characters
    r"¡-§©«-®°±¶·»¿"
    r"À-įıĴ-ľŁ-ňŊ-ž"
    r"Ѐ-ҁҊ-ӿ"                      # Cyrillic without combining marks
    r"‐‒-―‘-„•−"    # dashes, quotation marks, bullet
)
_SIMPLE_TEXT = f"^[{SIMPLE_CHARS}]*+$"

# Negation words, and a code with a subtype in brackets (also a damaged one),
# which stays inside its token while any other bracket separates tokens.
NEGATION = r"(?iU)\b(?:без|without|free\s+from)\b"
SUBTYPED_CODE = r"(?iU)((?<!\w)[eе][\s-]?\d{3,4}[a-zа-я]?\s*\([ivx][^,;)]*\)?)"

# Protected codes are fenced with two noncharacters, so that the token pattern moves over long
# texts in whole runs (a per-character alternation would exhaust the regex stack).
_FENCE = "\ufdd0\ufdd1"
TOKEN = r"((?:[^,;()\[\]{}\x{fdd0}]++|\x{fdd0}[^\x{fdd1}]*+\x{fdd1})++)"

# The characters which count as white space at the ends of a token.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_NON_WORD = re.compile(r"[^\w]+")


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``; keeps big expressions linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ship_to_workers() -> None:
    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)


@F.pandas_udf(T.StringType())
def _arrow_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(T.StringType())
def _arrow_normal_form(values: pd.Series) -> pd.Series:
    def one(value):
        if value is None:
            return None
        folded = unicodedata.normalize("NFKC", value).casefold()
        return _NON_WORD.sub(" ", folded.replace("ё", "е")).strip()

    return values.map(one)


def simple_normal_form(text: Column) -> Column:
    """JVM-only normal form; exact for texts made of SIMPLE_CHARS."""
    folded = F.replace(F.translate(F.lower(text), "ё", "е"), F.lit("ß"), F.lit("ss"))
    return F.btrim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


def normalize_text(text: Column, *, any_script: bool = True) -> Column:
    """Compatibility form, case folding, punctuation to single spaces.

    Texts outside the simple character set take the full Unicode path, an Arrow function that sees
    nulls for all simple texts. The expression is deterministic, so filters on other columns reach
    the scan below it. ``any_script=False`` is for inputs known to be simple, such as normalised columns.
    """
    if not any_script:
        return simple_normal_form(text)
    simple = is_simple(text)
    _ship_to_workers()
    return F.when(simple, simple_normal_form(text)).otherwise(_arrow_normal_form(F.when(~simple, text)))


def fold_text(text: Column) -> Column:
    """Compatibility form and case folding only; punctuation stays."""
    simple = is_simple(text)
    plain = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    _ship_to_workers()
    return F.when(simple, plain).otherwise(_arrow_fold(F.when(~simple, text)))


def is_simple(text: Column) -> Column:
    """True when the JVM expression is exact; ASCII texts are told by their byte length."""
    return (F.length(text) == F.octet_length(text)) | text.rlike(_SIMPLE_TEXT)


def needs_full_unicode(text: Column) -> Column:
    return ~is_simple(text)


def split_label(text: Column) -> Column:
    """Flat token list of a label; nested brackets become separate tokens."""
    fenced = F.when(
        text.rlike(r"\([ivxIVX]"), F.regexp_replace(text, SUBTYPED_CODE, f"{_FENCE[0]}$1{_FENCE[1]}")
    ).otherwise(text)
    parts = F.regexp_extract_all(fenced, F.lit(TOKEN), F.lit(1))
    trimmed = F.transform(parts, lambda part: F.btrim(F.translate(part, _FENCE, ""), F.lit(WHITE_SPACE)))
    return F.filter(trimmed, lambda part: part != "")


def is_negated(token: Column) -> Column:
    return token.rlike(NEGATION)


def collapse_spaces(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def strip_invisible(text: Column) -> Column:
    return collapse_spaces(F.regexp_replace(text, "​", ""))


def apply_corrections(tokens: Column, corrections: Column) -> Column:
    """Token list with replacements put in, or null when any correction is stale.

    ``corrections`` is ``array<struct<token_index, token_raw, corrected_text>>``; an index out of
    range or a differing original token makes the whole request stale.
    """

    def on_tokens(base: Column) -> Column:
        valid = F.forall(
            corrections,
            lambda c: F.coalesce(F.get(base, c["token_index"]) == c["token_raw"], F.lit(False)),
        )
        entries = F.transform(corrections, lambda c: F.struct(c["token_index"], c["corrected_text"]))
        replaced = bind(
            F.map_from_entries(entries),
            lambda by: F.transform(base, lambda token, i: F.coalesce(F.try_element_at(by, i), token)),
        )
        return F.when(valid, replaced)

    return bind(
        bind(tokens, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))), on_tokens
    )
