"""Verdicts of labels, with and without personal exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provisor.functions.severity import (
    PERSONAL_FLOOR, REASON_WEIGHTS, reason_name, reason_weight, risk_score, severity_name, verdict_level,
)

# Titles shown for a verdict.
TITLES = {
    "forbidden": "Есть ингредиенты с ограничениями",
    "avoid": "Лучше избегать",
    "attention": "С осторожностью",
    "personal": "Не подходит вам",
    "incomplete": "Недостаточно данных для оценки",
    "clear": "Предупреждений не найдено",
}

# Descriptions shown for a verdict.
DESCRIPTIONS = {
    "forbidden": "Найдены сведения о запрете применения отдельных ингредиентов. Учитывайте источники, их актуальность и условия применения.",
    "avoid": "В составе есть ингредиенты, которые лучше исключить или ограничить.",
    "attention": "В составе есть ингредиенты, требующие внимания.",
    "personal": "Найдены ингредиенты из ваших исключений: ",
    "incomplete": "Для части состава нет оценки или точного совпадения в справочнике. Это не подтверждает безопасность продукта.",
    "clear": "По найденным правилам предупреждений нет. Допустимость применения зависит от количества и категории продукта.",
}


def label_counts(resolved: DataFrame, keys: tuple[str, ...] = ("product_id",), with_hits: bool = False) -> DataFrame:
    """Counts a verdict needs, per label; ``resolved`` carries ``ingredient_id`` and ``weight``.

    Two map-side combined aggregates with numeric buffers: repeated ingredients fold first, so a
    label with very many tokens is spread over its ingredients before it meets in one row.
    ``with_hits`` adds ``hits``, the excluded ingredients of the label with their first positions.
    """
    folded = resolved.groupBy(*keys, "ingredient_id").agg(
        F.max("weight").alias("weight"), F.count("pos").alias("tokens"),
        *([F.max("personal").alias("personal")] if "personal" in resolved.columns else []),
        *([F.min("pos").alias("pos")] if with_hits else []),
    )
    found = F.col("ingredient_id").isNotNull()
    personal = F.coalesce(F.col("personal"), F.lit(False)) if "personal" in folded.columns else F.lit(False)
    return folded.groupBy(*keys).agg(
        F.count_if(found).alias("matched"),
        F.coalesce(F.sum(F.when(~found, F.col("tokens"))), F.lit(0)).alias("unmatched"),
        F.count_if(found & (F.col("weight") >= 1)).alias("warnings"),
        F.count_if(found & personal).alias("personal_hits"),
        F.coalesce(F.max(F.when(found, F.col("weight"))), F.lit(-1)).alias("weight"),
        F.count_if(found & (F.col("weight") < 0)).alias("unknown"),
        *([F.collect_list(F.when(found & personal, F.struct("pos", "ingredient_id"))).alias("hits")] if with_hits else []),
    )


def verdicts(counts: DataFrame) -> DataFrame:
    """Level, score and title per label from :func:`label_counts`."""
    hits = F.col("personal_hits")
    regulatory = reason_weight(severity_name(F.greatest(F.col("weight"), F.lit(0))))
    top = F.greatest(regulatory, F.when(hits > 0, REASON_WEIGHTS["personal"]).otherwise(0))
    scored = (
        counts.withColumn("reasons", F.col("warnings") + hits)
        .withColumn("severity", reason_name(top))
        .withColumn("incomplete", (F.col("unmatched") > 0) | (F.col("matched") == 0) | (F.col("unknown") > 0))
    )
    score = risk_score(F.col("severity"), F.col("reasons"), F.col("unmatched"))
    plain = F.when(F.col("severity") == "neutral", F.lit(0).cast("long")).otherwise(score)
    title = F.when(hits > 0, TITLES["personal"])
    for name in ("forbidden", "avoid", "attention"):
        title = title.when(F.col("severity") == name, TITLES[name])
    title = title.when(F.col("incomplete"), TITLES["incomplete"]).otherwise(TITLES["clear"])
    return (
        scored.withColumn("level", F.when(hits > 0, "risky_for_user").otherwise(verdict_level(F.col("severity"))))
        .withColumn("risk_score", F.when(hits > 0, F.greatest(F.lit(PERSONAL_FLOOR).cast("long"), score)).otherwise(plain))
        .withColumn("title", title)
        .drop("weight")
    )


def described(judged: DataFrame, names: DataFrame | None = None, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """:func:`verdicts` with the ``description`` shown to the user.

    With ``names`` (``ingredient_id``, ``e_code``, ``name``) a personal verdict lists code and name of
    the excluded ingredients in the order of the label, equal ones once; ``judged`` then carries ``hits``
    and its rows are unique per ``keys``. Hits are the only rows that meet the names. An ingredient
    without code and name adds an empty entry.
    """
    text = F.lit(DESCRIPTIONS["clear"])
    for test, kind in ((F.col("incomplete"), "incomplete"), *((F.col("severity") == k, k) for k in ("attention", "avoid", "forbidden"))):
        text = F.when(test, DESCRIPTIONS[kind]).otherwise(text)
    if names is None:
        return judged.withColumn("description", F.when(F.col("personal_hits") > 0, DESCRIPTIONS["personal"]).otherwise(text))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    shown = names.select(F.col("ingredient_id").alias("_hit"), F.concat_ws(" ", filled("e_code"), filled("name")).alias("_shown"))
    rest = [c for c in judged.columns if c not in (*keys, "hits")]
    spread = judged.select(*keys, F.struct(*rest).alias("_row"), F.explode_outer("hits").alias("_h")).select(
        *keys, "_row", F.col("_h.pos").alias("_pos"), F.col("_h.ingredient_id").alias("_hit")).join(shown, "_hit", "left")
    listed = spread.groupBy(*keys, "_row").agg(F.array_sort(F.collect_list(
        F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_shown")))).alias("_list"))
    named = F.array_join(F.array_distinct(F.transform("_list", lambda x: F.coalesce(x["_shown"], F.lit("")))), ", ")
    out = listed.select(*keys, "_row.*", named.alias("_names"))
    return out.withColumn("description", F.when(
        F.col("personal_hits") > 0, F.concat(F.lit(DESCRIPTIONS["personal"]), F.col("_names"))).otherwise(text)).drop("_names")


def with_personal_hits(
    resolved: DataFrame, exclusions: DataFrame, excluded_names: DataFrame | None = None
) -> DataFrame:
    """Flag tokens whose ingredient the user excluded, by identifier or by normal-form name.

    ``resolved`` carries ``user_id``; the two conditions are joined one after the other, so no
    join has an OR condition.
    """
    by_id = exclusions.select("user_id", "ingredient_id").distinct().withColumn("_by_id", F.lit(True))
    out = resolved.join(by_id, ["user_id", "ingredient_id"], "left")
    hit = F.coalesce(F.col("_by_id"), F.lit(False))
    if excluded_names is None:
        return out.withColumn("personal", hit).drop("_by_id")
    by_name = excluded_names.select("user_id", "normalized_name").distinct().withColumn("_by_name", F.lit(True))
    out = out.join(by_name, ["user_id", "normalized_name"], "left")
    return out.withColumn("personal", hit | F.coalesce(F.col("_by_name"), F.lit(False))).drop("_by_id", "_by_name")


def reason_rows(resolved: DataFrame, names: DataFrame, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """One row per reason of a verdict: regulatory ones and personal ones, by first position."""
    personal = F.max("personal") if "personal" in resolved.columns else F.lit(False)
    folded = resolved.where(F.col("ingredient_id").isNotNull()).groupBy(*keys, "ingredient_id").agg(
        F.max("weight").alias("weight"), F.min("pos").alias("pos"), personal.alias("personal")
    )
    kinds = F.array_compact(F.array(
        F.when(F.col("weight") >= 1, severity_name(F.col("weight"))),
        F.when(F.coalesce(F.col("personal"), F.lit(False)), F.lit("personal")),
    ))
    return folded.select(*keys, "ingredient_id", "pos", F.explode(kinds).alias("severity")).join(
        names, "ingredient_id"
    )


def display_risk(severity: str = "severity", rules: str = "rules"):
    """Risk class of one ingredient as displayed."""
    s = F.col(severity)
    return (
        F.when(s.isin("avoid", "forbidden"), "avoid").when(s == "attention", "warning")
        .when((s == "unknown") | (F.col(rules) == 0), "unknown").otherwise("neutral")
    )


def display_level(level: str = "level"):
    """Risk class of a whole product as displayed."""
    c = F.col(level)
    return F.when(c.isin("dangerous", "risky_for_user"), "avoid").when(c == "attention", "warning").otherwise("unknown")


def best_of(compared: DataFrame, key: str = "comparison_id") -> DataFrame:
    """Winner of each comparison: lowest score, first position on ties."""
    best = F.min(F.struct("risk_score", "position")).alias("_best")
    return compared.groupBy(key).agg(best, F.count(F.lit(1)).alias("products")).select(
        key, F.col("_best.position").alias("winner_position"), F.col("_best.risk_score").alias("winner_score"), "products")
