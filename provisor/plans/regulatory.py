"""Regulatory bundle: extracted rules enriched with evidence, seeded status rules, alias clean-up.

Texts, sources and code lists of a jurisdiction are inputs, not part of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import code_spellings
from provisor.functions.ids import name_uuid
from provisor.functions.text import normalize_text
from provisor.operators import merge, quality
from provisor.operators.aliases import ID_PREFIX, alias_rows, retired_by_note

# Rule types that are fragments of a source, and how a removed position is worded.
FRAGMENT_TYPES = ("regulatory_text", "source_metadata", "source_amendment_note", "source_table_note")
REMOVED = r"(?iU)позици[яи].{0,20}исключен"
NO_LOCATOR = "Место в документе требует проверки"
RETIRED_NOTE = "позиция исключена"


def enrich_references(rules: DataFrame, sources: DataFrame) -> DataFrame:
    """Record kind, verification, locator, source-text hash and evidence of extracted rules.

    ``rules``: rule_id, source_id, rule_type, title, explanation, citation, source_text, appendix,
    table, row. Every extracted rule is reference-only until a person verifies it.
    """
    src = sources.select("source_id", F.col("code").alias("source_code"), F.col("url").alias("source_url"))
    rows = rules.join(src, "source_id")
    citation = F.coalesce("citation", F.lit(""))
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    loose = F.col("rule_type").isin(*FRAGMENT_TYPES) | F.coalesce(F.col("explanation"), F.lit("")).rlike(REMOVED)
    in_table = F.col("appendix").isNotNull()
    in_point = citation.rlike(r"(?U)пункт \d")
    place = F.concat(
        F.concat(F.col("source_code"), F.lit(", приложение "), F.col("appendix").cast("string")),
        F.coalesce(F.concat(F.lit(", таблица "), F.col("table").cast("string")), F.lit("")),
        F.lit(", позиция: "), F.coalesce(filled("source_text"), filled("explanation"), F.col("title")))
    reference = ~loose & (in_table | in_point)
    locator = F.when(loose, citation).when(in_table, place).otherwise(F.coalesce(F.nullif(citation, F.lit("")), F.lit(NO_LOCATOR)))
    status = F.when(reference, "extracted_not_verified").otherwise("needs_review")
    enriched = rows.withColumns({
        "original_citation": citation,
        "evaluation": F.lit("reference_only"),
        "source_text_sha256": F.sha2(F.coalesce(filled("source_text"), filled("explanation"), F.lit("")), 256),
        "record_kind": F.when(reference, "normative_reference").otherwise("source_fragment"),
        "verification_status": status,
        "locator": locator,
    })
    item = _evidence(F.col("source_id"), F.col("source_code"), F.col("source_url"), F.col("locator"), "consolidated_copy", F.col("verification_status"), F.lit(None))
    return enriched.withColumn("evidence", F.array(item)).withColumn(
        "citation", F.concat(F.col("locator"), F.lit(" | "), F.coalesce("source_url", F.lit("")))).drop("source_code", "source_url", "locator")


def _evidence(source_id: Column, code: Column, url: Column, locator: Column, role: str, status: Column, page: Column) -> Column:
    return F.struct(
        source_id.cast("string").alias("source_id"), code.alias("source_code"), url.alias("url"), locator.alias("locator"),
        F.lit(role).alias("document_role"), status.cast("string").alias("verification_status"), page.cast("int").alias("pdf_page"))


def seeded_ingredients(seed: DataFrame, ingredients: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Seed rows with their ingredient: by code, else by name, else a new id.

    ``seed``: status, code, name, name_en, category, item_key.
    """
    by_code = ingredients.where("e_code is not null").groupBy(F.upper("e_code").alias("_key")).agg(F.min("ingredient_id").alias("_by_code"))
    by_name = ingredients.groupBy(normalize_text(F.col("name")).alias("_form")).agg(F.min("ingredient_id").alias("_by_name"))
    rows = seed.withColumn("_key", F.upper("code")).withColumn("_form", normalize_text(F.col("name")))
    return rows.join(by_code, "_key", "left").join(by_name, "_form", "left").withColumn(
        "ingredient_id", F.coalesce("_by_code", "_by_name", name_uuid(prefix, "ingredient", F.col("item_key")))
    ).drop("_key", "_form", "_by_code", "_by_name")


def status_rules(seeded: DataFrame, acts: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """BANNED and PHASE_OUT rules of seed rows.

    ``acts`` holds per status the source and wording: status, source_id, source_code, url,
    locator_head, document_role, act_status, pdf_page, explanation, effective_from, and the
    ``transition`` struct (null for bans).
    """
    rows = seeded.join(acts, "status")
    locator = F.concat(F.col("locator_head"), F.coalesce("code", "name"))
    item = F.struct(
        F.col("source_id").cast("string").alias("source_id"), F.col("source_code").alias("source_code"), F.col("url").alias("url"),
        locator.alias("locator"), F.col("document_role").alias("document_role"), F.col("act_status").alias("verification_status"),
        F.col("pdf_page").cast("int").alias("pdf_page"))
    ban = F.col("status") == "BANNED"
    return rows.select(
        name_uuid(prefix, "rule", F.concat_ws("/", "status", "item_key")).alias("rule_id"), "ingredient_id", "source_id",
        F.lit("regulatory_status").alias("rule_type"), F.lit("attention").alias("severity"),
        F.concat(F.col("status"), F.lit(": "), F.col("name")).alias("title"), "explanation",
        F.concat(locator, F.lit(" | "), F.col("url")).alias("citation"), F.col("status").alias("regulatory_status"),
        F.lit("notice").alias("evaluation"), F.lit("exact_only").alias("match_policy"), F.lit("status_rule").alias("record_kind"),
        F.lit("use_as_food_additive").alias("scope"), F.col("act_status").alias("verification_status"),
        F.when(ban, F.lit(True)).alias("primary_basis_required"), F.when(ban, F.lit(False)).alias("production_ready"),
        F.array(item).alias("evidence"), "transition", "effective_from")


def refine_rules(rules: DataFrame, ingredients: DataFrame, special: DataFrame, label_notices: DataFrame, introduced: DataFrame) -> DataFrame:
    """Status of warning-label and permitted rules.

    ``label_notices``: code, locator, url, source_id, source_code, pdf_page for warning labels.
    ``introduced``: the same columns plus effective_from for newly permitted codes, whose evidence
    is added to the extracted one.
    """
    codes = ingredients.select("ingredient_id", F.upper("e_code").alias("code"))
    chosen = special.select("ingredient_id").distinct().withColumn("_special", F.lit(True))
    item = lambda p, role, status: _evidence(
        F.col(f"{p}.source_id"), F.col(f"{p}.source_code"), F.col(f"{p}.url"), F.col(f"{p}.locator"), role, F.lit(status), F.col(f"{p}.pdf_page"))
    pack = lambda df, name: df.select(F.upper("code").alias("code"), F.struct(*[c for c in df.columns if c != "code"]).alias(name))
    rows = (
        rules.join(codes, "ingredient_id", "left").join(chosen, "ingredient_id", "left")
        .join(pack(label_notices, "_notice"), "code", "left").join(pack(introduced, "_new"), "code", "left"))
    notice = (F.col("rule_type") == "mandatory_warning_label") & F.col("_notice").isNotNull()
    permitted = (F.col("rule_type") == "permitted_food_additive") & F.col("_special").isNull()
    fresh = permitted & F.col("_new").isNotNull()
    pick = lambda test, value, column: F.when(test, value).otherwise(F.col(column))
    return rows.withColumns({
        "regulatory_status": F.when(notice, "ATTENTION").when(permitted, "PERMITTED_WITH_CONDITIONS").otherwise(F.col("regulatory_status")),
        "evaluation": pick(notice, "notice", "evaluation"),
        "verification_status": pick(notice, "verified_primary", "verification_status"),
        "match_policy": pick(notice, "exact_only", "match_policy"),
        "severity": pick(notice, "attention", "severity"),
        "citation": pick(notice, F.concat(F.col("_notice.locator"), F.lit(" | "), F.col("_notice.url")), "citation"),
        "evidence": F.when(notice, F.array(item("_notice", "normative_act", "verified_primary")))
            .when(fresh, F.array_append("evidence", item("_new", "normative_act", "verified_primary"))).otherwise(F.col("evidence")),
        "effective_from": pick(fresh, F.col("_new.effective_from"), "effective_from"),
        "required_context": F.when(permitted, F.array(*[F.lit(x) for x in ("food_category", "concentration", "technological_function")])),
    }).drop("code", "_special", "_notice", "_new")


def split_fragments(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active rules and source fragments: two complementary filters."""
    fragment = F.coalesce(F.col("record_kind") == "source_fragment", F.lit(False))
    return rules.where(~fragment), rules.where(fragment)


def seed_aliases(seeded: DataFrame, extra: DataFrame, ambiguous: DataFrame, source: str, prefix: str = ID_PREFIX) -> DataFrame:
    """Names, additional names (item_key, alias) and code spellings of seed rows as aliases."""
    named = seeded.select("ingredient_id", F.explode(F.array_compact(F.array("name", "name_en"))).alias("alias"))
    more = seeded.join(extra, "item_key").select("ingredient_id", "alias")
    spelled = seeded.where("code is not null").select("ingredient_id", F.explode(code_spellings(F.col("code"))).alias("alias"))
    union = named.unionByName(more).unionByName(spelled).distinct()
    clear = union.withColumn("form", normalize_text(F.col("alias"))).join(ambiguous.select("form"), "form", "left_anti").drop("form")
    language = F.when(F.col("alias").rlike("[а-яА-Я]"), "ru").otherwise("en")
    return alias_rows(clear, "ingredient_id", language, "alias", F.lit(source), prefix)


def build_regulatory(
    bundles: list[dict[str, DataFrame]], seed: DataFrame, acts: DataFrame, extra_aliases: DataFrame, ambiguous: DataFrame,
    label_notices: DataFrame, introduced: DataFrame, preferences: DataFrame | None = None, prefix: str = ID_PREFIX,
) -> dict[str, DataFrame]:
    """The whole build: first-wins union, enrichment, status rules, aliases, refinement, split."""
    from provisor.session import cut_lineage

    keys = {"regulatory_sources": "source_id", "ingredients": "ingredient_id", "ingredient_aliases": "alias_id", "ingredient_rules": "rule_id"}
    t = {name: merge.first_wins([b[name] for b in bundles], key) for name, key in keys.items()}
    t["regulatory_sources"] = merge.first_wins([t["regulatory_sources"], acts.select("source_id", F.col("source_code").alias("code"), "url").distinct()], "source_id")
    seeded = cut_lineage(seeded_ingredients(seed, t["ingredients"], prefix), "seeded-ingredients")
    fresh = seeded.select(
        "ingredient_id", F.lit("food_additive").alias("kind"), F.col("code").alias("e_code"), "name", "name_en", "category",
        F.concat(F.col("name"), F.lit(" ("), F.col("name_en"), F.lit(")")).alias("description"), F.lit(True).alias("is_active"))
    ingredients = merge.first_wins([fresh, t["ingredients"]], "ingredient_id")
    given = [seed_aliases(seeded, extra_aliases, ambiguous, "regulatory_status_seed", prefix), t["ingredient_aliases"]]
    if preferences is not None:
        legacy, extra_rows = preference_aliases(preferences, ingredients, prefix)
        ingredients = ingredients.unionByName(extra_rows, allowMissingColumns=True)
        given.insert(0, legacy)
    aliases = merge.first_wins(given, "alias_id")
    kept, retired = retired_by_note(aliases, seeded, ambiguous, RETIRED_NOTE)
    rules = enrich_references(t["ingredient_rules"], t["regulatory_sources"])
    rules = status_rules(seeded, acts, prefix).unionByName(rules, allowMissingColumns=True)
    refined = cut_lineage(refine_rules(rules, ingredients, seeded, label_notices, introduced), "regulatory-rules")
    active, fragments = split_fragments(refined)
    return {
        "regulatory_sources": t["regulatory_sources"], "ingredients": ingredients, "ingredient_aliases": kept,
        "retired_aliases": retired, "ingredient_rules": active, "source_fragments": fragments,
    }


def preference_aliases(preferences: DataFrame, ingredients: DataFrame, prefix: str = ID_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Former preference entries (id, name, code, category, description) as aliases of the catalog,
    and the ingredients that have to be added for them."""
    rows = preferences.select(
        F.lit("p").alias("status"), "code", "name", F.lit(None).cast("string").alias("name_en"), "category", "description", "id",
        F.concat(F.lit("preference/"), F.col("id")).alias("item_key"))
    found = seeded_ingredients(rows, ingredients, prefix)
    names = [
        alias_rows(found, "ingredient_id", F.lit("ru"), column, F.lit(source), prefix)
        for column, source in (("name", "preference_name"), ("id", "legacy_preference_id"))
    ]
    fresh = found.join(ingredients.select("ingredient_id"), "ingredient_id", "left_anti").select(
        "ingredient_id", F.lit("ingredient").alias("kind"), F.col("code").alias("e_code"), "name", "category", "description",
        F.lit(True).alias("is_active"))
    return names[0].unionByName(names[1]), fresh


def regulatory_violations(t: dict[str, DataFrame]) -> DataFrame:
    """Duplicates, orphans, retired names in use, evidence gaps of a regulatory bundle."""
    rules = t["ingredient_rules"]
    whole = F.forall("evidence", lambda e: (F.coalesce(e["locator"], F.lit("")) != "") & (F.coalesce(e["url"], F.lit("")) != ""))
    sourced = rules.select("rule_id", F.explode("evidence.source_id").alias("source_id"))
    return quality.union_all([
        *[quality.duplicate_keys(n, t[n], k) for n, k in (
            ("regulatory_sources", "source_id"), ("ingredients", "ingredient_id"), ("ingredient_aliases", "alias_id"), ("ingredient_rules", "rule_id"))],
        quality.duplicate_keys("ingredients", t["ingredients"], F.upper("e_code"), "duplicate_code"),
        quality.orphans("ingredient_aliases", t["ingredient_aliases"], "ingredient_id", t["ingredients"], "ingredient_id"),
        quality.orphans("ingredient_rules", rules, "ingredient_id", t["ingredients"], "ingredient_id"),
        quality.orphans("ingredient_rules", rules, "source_id", t["regulatory_sources"], "source_id"),
        quality.orphans("rule_evidence", sourced, "source_id", t["regulatory_sources"].withColumn("source_id", F.col("source_id").cast("string")), "source_id"),
        quality.key_set_overlap("retired_and_active_aliases", t["retired_aliases"], t["ingredient_aliases"], "alias_id"),
        quality.key_set_overlap("rules_and_fragments", rules, t["source_fragments"], "rule_id"),
        quality.failing_rows("ingredient_rules", rules, "rule_id", {
            "citation": F.coalesce("citation", F.lit("")) != "",
            "evidence": (F.size("evidence") > 0) & whole}),
        quality.failing_rows("source_fragments", t["source_fragments"], "rule_id", {"evaluation": F.col("evaluation").eqNullSafe("reference_only")}),
    ])


def rules_to_review(rules: DataFrame) -> DataFrame:
    """Rules with any evidence that no one verified against the primary text."""
    return rules.where(F.exists("evidence", lambda e: ~e["verification_status"].eqNullSafe("verified_primary"))).select(
        "rule_id", "citation", F.transform("evidence", lambda e: e["verification_status"]).alias("statuses"))
