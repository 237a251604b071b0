"""Enrich a catalog from a taxonomy: entries, parents, properties, aliases, new ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provisor.functions.codes import is_code_like, strict_code
from provisor.functions.ids import name_uuid
from provisor.functions.text import normalize_text
from provisor.operators.aliases import ID_PREFIX, alias_rows, quarantine
from provisor.operators.quality import alias_owners, ambiguity_report
from provisor.session import cut_lineage
from provisor.sources.taxonomy import first_names, parse_taxonomy, property_conflicts


def match_entries(parsed: dict[str, DataFrame], ingredients: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Each entry with its ingredient: exactly one known code, else review, new or untranslated."""
    known = ingredients.where("e_code is not null").select(
        strict_code(F.col("e_code")).alias("code"), F.col("ingredient_id").alias("_by_code"))
    names = parsed["names"].withColumn("code", strict_code(F.col("name")))
    codes = names.groupBy("key").agg(
        F.min("code").alias("code"), F.max("code").alias("_last"),
        F.coalesce(F.bool_or(is_code_like(F.col("name"))), F.lit(False)).alias("_code_like"))
    rows = (
        parsed["entries"].join(codes, "key").join(known, "code", "left")
        .join(first_names(parsed["names"], "ru", "name"), "key", "left")
        .join(first_names(parsed["names"], "en", "name_en"), "key", "left")
    )
    exact = (F.col("code") == F.col("_last")) & F.col("_by_code").isNotNull()
    method = (
        F.when(exact, "exact_e_code").when(F.col("code").isNotNull() | F.col("_code_like"), "code_review_required")
        .when(F.col("name").isNotNull(), "new_ordinary_ingredient").otherwise("untranslated")
    )
    return rows.withColumn("match_method", method).select(
        name_uuid(prefix, "taxonomy_entry", F.col("key")).alias("entry_id"), "key", "line", "name", "name_en", "match_method",
        F.when(F.col("match_method") == "exact_e_code", F.col("_by_code"))
        .when(F.col("match_method") == "new_ordinary_ingredient", name_uuid(prefix, "taxonomy_ingredient", F.col("key")))
        .alias("ingredient_id"),
    )


def resolve_parents(parsed: dict[str, DataFrame], entries: DataFrame, prefix: str = ID_PREFIX) -> DataFrame:
    """Parents by (language, normal form) when exactly one entry owns the name; else the reason."""
    ids = entries.select("key", "entry_id")
    owners = parsed["names"].join(ids, "key").groupBy("language", normalize_text(F.col("name")).alias("form")).agg(
        F.min("entry_id").alias("_first"), F.max("entry_id").alias("_last"))
    rows = parsed["parents"].withColumn("form", normalize_text(F.col("name"))).join(owners, ["language", "form"], "left").join(ids, "key")
    reference = F.concat_ws(":", "language", "name")
    one = F.col("_first") == F.col("_last")
    return rows.select(
        name_uuid(prefix, "taxonomy_parent", F.col("key"), reference).alias("parent_id"), "entry_id",
        F.when(one, F.col("_first")).alias("parent_entry_id"), reference.alias("parent_reference"),
        F.when(F.col("_first").isNull(), "missing").when(~one, "ambiguous").alias("reason"))


def enrich_catalog(base: dict[str, DataFrame], lines: DataFrame, source: str, prefix: str = ID_PREFIX) -> tuple[dict, dict]:
    """New catalog tables and report sections; ``base`` stays as it is.

    ``base`` has ``ingredients`` and ``ingredient_aliases`` (with ``position``). The text claims
    of a taxonomy never create rules.
    """
    # The parse feeds a dozen outputs, so its parts are written once.
    parsed = {name: cut_lineage(df, f"taxonomy-{name}") for name, df in parse_taxonomy(cut_lineage(lines, "taxonomy-lines")).items()}
    entries = cut_lineage(match_entries(parsed, base["ingredients"], prefix), "taxonomy-matches")
    fresh = entries.where("match_method = 'new_ordinary_ingredient'").select(
        "ingredient_id", F.lit("ingredient").alias("kind"), "name", "name_en", F.lit(True).alias("is_active"))
    ingredients = base["ingredients"].unionByName(fresh, allowMissingColumns=True)
    own = [
        alias_rows(base["ingredients"].where(F.col(c).isNotNull()), "ingredient_id", F.lit(lang), c, F.lit(None), prefix)
        .withColumn("position", F.struct(F.lit(1), F.lit(""), F.lit(order), F.col("alias_id")))
        for order, (lang, c) in enumerate((("ru", "name"), ("en", "name_en")))
    ]
    known = base["ingredients"].where("e_code is not null").select(strict_code(F.col("e_code")).alias("_code"))
    named = parsed["names"].where(F.col("language").isin("ru", "en")).join(
        entries.where("ingredient_id is not null").select("key", "ingredient_id"), "key").withColumn("_code", strict_code(F.col("name")))
    foreign = named.where(is_code_like(F.col("name"))).join(known, "_code", "left_anti").select("key", "language", "name")
    usable = named.join(foreign, ["key", "language", "name"], "left_anti")
    given = base["ingredient_aliases"].withColumn(
        "position", F.struct(F.lit(0), F.lit(""), F.lit(0), F.lpad(F.col("position").cast("string"), 20, "0")))
    from_taxonomy = alias_rows(usable, "ingredient_id", F.col("language"), "name", F.lit(source), prefix).withColumn(
        "position", F.struct(F.lit(2), F.lit(""), F.lit(0), F.col("alias_id")))
    names = ["col1", "col2", "col3", "col4"]
    parts = [
        df.withColumn("position", F.struct(*[F.col(f"position.{df.schema['position'].dataType.names[i]}").alias(n) for i, n in enumerate(names)]))
        for df in (given, *own, from_taxonomy)
    ]
    aliases = parts[0]
    for part in parts[1:]:
        aliases = aliases.unionByName(part, allowMissingColumns=True)
    judged = cut_lineage(quarantine(aliases.select(*parts[1].columns), ingredients), "taxonomy-aliases")
    parents = resolve_parents(parsed, entries, prefix)
    ids = entries.select("key", "entry_id")
    properties = parsed["properties"].join(ids, "key").select(
        name_uuid(prefix, "taxonomy_property", F.col("key"), F.col("property"), F.col("language"), F.col("value")).alias("property_id"),
        "entry_id", "property", "language", "value", F.lit("reference_only").alias("verification_status"))
    tables = {
        **base,
        "ingredients": ingredients,
        "ingredient_aliases": judged.where("reason is null").drop("reason"),
        "ingredient_alias_review": judged.where("reason is not null"),
        "taxonomy_entries": entries,
        "taxonomy_parents": parents.drop("reason"),
        "taxonomy_properties": properties,
    }
    report = {
        "duplicate_blocks": parsed["duplicate_blocks"], "unparsed_lines": parsed["unparsed_lines"],
        "ignored_directives": parsed["ignored_directives"],
        "code_review": entries.where("match_method = 'code_review_required'").select("key", "line"),
        "match_methods": entries.groupBy("match_method").agg(F.count(F.lit(1)).alias("n")),
        "unresolved_parents": parents.where("reason is not null").select("entry_id", "parent_reference", "reason"),
        "property_conflicts": property_conflicts(parsed["properties"]),
        "ambiguous_aliases": ambiguity_report(alias_owners(ingredients, aliases), ingredients),
    }
    return tables, report
