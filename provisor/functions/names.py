"""Ingredient names, descriptions and taxonomy keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provisor.functions.codes import strict_code
from provisor.functions.text import fold_text

# Limits of a clean English name and the words of an excerpt.
ENGLISH_MAX_CHARS = 180
EXCERPT_WORDS = 25
CYRILLIC = r"[Ѐ-ӿ]"


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def english_name(value: Column) -> Column:
    """Leading clean English name, or null for codes, mixed scripts and broken brackets.

    The text ends before the first closing bracket that has no opening one; a text whose
    brackets stay open is cut before its first bracket.
    """
    text = F.btrim(value)
    chars = F.split(text, "")
    # Fold: running depth and the index of the first unmatched closing bracket (-1: none yet).
    state = F.aggregate(
        F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"))),
        F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("cut")),
        lambda s, x: F.struct(
            F.when(s["cut"] >= 0, s["depth"])
            .when(x["c"] == "(", s["depth"] + 1)
            .when((x["c"] == ")") & (s["depth"] > 0), s["depth"] - 1)
            .otherwise(s["depth"]).alias("depth"),
            F.when(s["cut"] >= 0, s["cut"])
            .when((x["c"] == ")") & (s["depth"] == 0), x["i"])
            .otherwise(s["cut"]).alias("cut"),
        ),
    )
    balanced = F.when(state["cut"] >= 0, F.substring(text, F.lit(1), state["cut"])).otherwise(text)
    closed = F.when(_count(balanced, "(") > _count(balanced, ")"),
                    F.btrim(F.substring_index(balanced, "(", 1))).otherwise(balanced)
    name = F.btrim(closed, F.lit(" ,;:."))
    usable = (
        ~name.rlike(CYRILLIC) & (F.length(name) <= ENGLISH_MAX_CHARS) & name.rlike("[a-zA-Z]{3}")
        & strict_code(name).isNull() & (_count(name, "(") == _count(name, ")"))
    )
    return F.when(usable, name)


def clean_description(text: Column, banned_terms: list[str]) -> Column:
    """Drop every sentence that names one of ``banned_terms`` as a word; null when none is left."""
    words = "|".join(banned_terms)
    kept = F.filter(
        F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: ~s.rlike(rf"(?iU)\b(?:{words})\b")
    )
    joined = F.array_join(kept, " ")
    return F.when(text == "", text).when(joined != "", joined)


def escaped_names(value: Column) -> Column:
    """Comma list in which a backslash makes the next character literal."""
    pieces = F.regexp_extract_all(value, F.lit(r"((?:[^,\\]++|\\.)++)"), F.lit(1))
    plain = F.transform(pieces, lambda p: F.btrim(F.regexp_replace(p, r"\\(.)", "$1")))
    return F.filter(plain, lambda p: p != "")


def taxonomy_key(language: Column, name: Column) -> Column:
    return F.concat(
        language, F.lit(":"), F.btrim(F.regexp_replace(fold_text(name), r"(?U)\s+", " "))
    )


def script_language(text: Column) -> Column:
    return F.when(text.rlike(CYRILLIC), "ru").otherwise("en")


def excerpt(text: Column, words: int = EXCERPT_WORDS) -> Column:
    """Struct of the first ``words`` words (with an ellipsis when cut) and the cut flag."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    cut = F.size(parts) > words
    head = F.array_join(F.slice(parts, 1, words), " ")
    return F.struct(
        F.when(F.size(parts) > 0, F.concat(head, F.when(cut, F.lit("…")).otherwise(""))).alias("excerpt"),
        cut.alias("truncated"),
    )
