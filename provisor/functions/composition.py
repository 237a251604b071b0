"""Composition text: cleaning, plausibility and the composition block of a raw label text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from provisor.functions.text import bind, collapse_spaces

# Labels, end markers, hint stems and section keywords of a product label.
LEADING_LABEL = r"(?iU)^\s*(?:состав|ингредиенты)\s*[:\-–—.]?\s*"
END_MARKERS = (
    r"(?iU)\b(?:пищевая\s+ценность|энергетическая\s+ценность|срок\s+годности|условия\s+хранения"
    r"|хранить\s+при|масса\s+нетто|изготовитель|производитель)\b"
)
CODE_HINT = r"(?iU)\b[еe]\s*-?\s*\d{3,4}[a-zа-я]?\b"
STEM_HINT = (
    r"(?iU)\b(?:вода|сахар|соль|мука|молоко|масло|жир|белок|сыворот|какао|крахмал|клетчат|лецитин"
    r"|кислота|сироп|ароматизатор|краситель|консервант|эмульгатор|стабилизатор|подсластитель"
    r"|регулятор|загуститель|разрыхлитель)\w*"
)
COMPOSITION_WORDS = ["состав", "ингредиенты"]
ALLERGEN_WORDS = ["содержит", "содержать", "может"]
FACILITY_WORDS = ["произведено", "производстве", "предприятии"]
SECTION_ENDS = [
    "пищевая ценность", "энергетическая ценность", "условия хранения", "срок годности",
    "масса нетто", "хранить при", "калорийность",
]
LATIN_LOOKALIKES = "ABCEHKMOPTXYaceopxy"
CYRILLIC_LOOKALIKES = "АВСЕНКМОРТХУасеорху"
# Letters that are Cyrillic once look-alikes are replaced.
WORD_CHARS = "А-Яа-яЁё" + LATIN_LOOKALIKES
EDGE_CHARS = " ,;:.-–—"
BLOCK_EDGE_CHARS = " :–—-.,;\"'«»_—|\\"
TAIL_EDGE_CHARS = " :–—-."
ALLERGEN_EDGE_CHARS = " .,:;\"'«»_—|\\"


def clean_composition(text: Column) -> Column:
    """One-line composition without its heading and without what follows an end marker."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\r\n•|", "  , ")
    flat = F.regexp_replace(F.regexp_replace(flat, "Е ", "E "), LEADING_LABEL, "")
    end = F.regexp_instr(flat, F.lit(END_MARKERS))
    flat = F.when(end > 0, F.substring(flat, F.lit(1), end - 1)).otherwise(flat)
    flat = F.regexp_replace(flat, r"(?U)\s*[,;]\s*", ", ")
    return F.btrim(F.regexp_replace(flat, r"(?U)\s+", " "), F.lit(EDGE_CHARS))


def is_composition(text: Column) -> Column:
    """At least three characters with a code, a typical stem, a comma or a semicolon."""
    value = collapse_spaces(text)
    return (F.length(value) >= 3) & (
        value.rlike(CODE_HINT) | value.rlike(STEM_HINT) | value.contains(",") | value.contains(";")
    )


def is_sufficient(status: Column, text: Column) -> Column:
    return F.coalesce((status == "success") & (collapse_spaces(text) != "") & is_composition(text), F.lit(False))


def to_cyrillic_lookalikes(text: Column) -> Column:
    return F.translate(text, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)


def fuzzy_spans(text: Column, keywords: list[str], start: Column | int = 0) -> Column:
    """Span (start, end) of the first Cyrillic word close to a keyword at or after ``start``.

    Close means two edits for keywords of up to seven letters, three for longer ones. ``start``
    must not lie inside a word. Offsets are zero-based; the result is null when nothing is close.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    bounds = {k: 2 if len(k) <= 7 else 3 for k in keywords}
    least = min(len(k) - bound for k, bound in bounds.items())

    def close(word: Column) -> Column:
        # Lengths differ for almost every word, so the distance is rarely computed.
        folded, hit = F.lower(to_cyrillic_lookalikes(word)), F.lit(False)
        for keyword, bound in bounds.items():
            hit = hit | (
                F.length(word).between(len(keyword) - bound, len(keyword) + bound)
                & (F.levenshtein(folded, F.lit(keyword), bound) >= 0)
            )
        return hit

    def span(rest: Column) -> Column:
        # The first close word is the first of its spelling, so the text before it is sought once.
        words = F.regexp_extract_all(rest, F.lit(f"[{WORD_CHARS}]{{{least},}}+"), F.lit(0))

        def place(word: Column) -> Column:
            whole = F.concat(F.lit(f"(?<![{WORD_CHARS}])"), word, F.lit(f"(?![{WORD_CHARS}])"))
            return F.when(word.isNotNull(), bind(start + F.length(F.split(rest, whole, 2)[0]), lambda before: F.struct(
                before.alias("start"), (before + F.length(word)).alias("end"))))

        return bind(F.get(F.filter(words, close), F.lit(0)), place)

    # Lower-casing makes two characters of this letter only; offsets count them so.
    return bind(F.replace(F.substring(text, start + 1, F.length(text)), F.lit("\u0130"), F.lit("i\u0307")), span)


def _first_marker(text: Column, start: Column) -> Column:
    """Smallest zero-based offset of a section end at or after ``start``; null when none."""

    def least(lowered: Column) -> Column:
        return F.least(*[
            F.nullif(F.call_function("locate", F.lit(m), lowered, (start + 1).cast("int")), F.lit(0)) - 1
            for m in SECTION_ENDS
        ])

    return bind(F.lower(text), least)


def composition_block(raw: Column) -> Column:
    """Text from the composition heading to the first allergen, facility or end marker."""
    text = F.replace(raw, F.lit("\n"), F.lit(" "))

    def cut(start: Column) -> Column:
        end = F.least(
            fuzzy_spans(text, ALLERGEN_WORDS, start)["start"],
            fuzzy_spans(text, FACILITY_WORDS, start)["start"],
            _first_marker(text, start),
            F.length(text),
        )
        return F.btrim(F.substring(text, start + 1, end - start), F.lit(BLOCK_EDGE_CHARS))

    return bind(F.coalesce(fuzzy_spans(text, COMPOSITION_WORDS)["end"], F.lit(0)), cut)


def allergen_block(raw: Column) -> Column:
    """Text after the allergen or facility warning up to an end marker; empty when absent."""
    text = F.replace(raw, F.lit("\n"), F.lit(" "))

    def begin(after: Column) -> Column:
        return F.coalesce(
            fuzzy_spans(text, ALLERGEN_WORDS, after)["end"],
            fuzzy_spans(text, FACILITY_WORDS, after)["end"],
        )

    def finish(tail: Column) -> Column:
        cut = _first_marker(tail, F.lit(0))
        kept = F.when(cut.isNotNull(), F.substring(tail, F.lit(1), cut)).otherwise(tail)
        return F.coalesce(F.btrim(kept, F.lit(ALLERGEN_EDGE_CHARS)), F.lit(""))

    start = bind(F.coalesce(fuzzy_spans(text, COMPOSITION_WORDS)["end"], F.lit(0)), begin)
    tail = F.ltrim(F.substring(text, start + 1, F.length(text)), F.lit(TAIL_EDGE_CHARS))
    return bind(tail, finish)
