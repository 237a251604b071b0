"""Flat catalog tables from nested rule and profile records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from provisor.functions.cells import is_host_of
from provisor.functions.ids import name_uuid
from provisor.functions.names import clean_description
from provisor.operators import quality
from provisor.operators.aliases import ID_PREFIX

CONDITIONS = (
    "regulatory_status", "scope", "jurisdiction", "verification_status", "evaluation", "match_policy",
    "primary_basis_required", "production_ready",
)
EVIDENCE = ("source_id", "url", "locator", "document_role", "verification_status", "pdf_page", "appendix", "table")
KINDS = ("additive_profile", "document_reference", "regulatory_match")


def flatten_rules(rules: DataFrame, prefix: str = ID_PREFIX) -> dict[str, DataFrame]:
    """Rules with their condition columns, evidence rows with index-based ids, transitions.

    ``conditions`` is a struct with ``evidence`` (array of structs) and ``transition`` (struct).
    """
    have = rules.schema["conditions"].dataType.names
    flat = rules.select(
        *[c for c in rules.columns if c != "conditions"],
        *[F.col(f"conditions.{c}").alias(c) if c in have else F.lit(None).alias(c) for c in CONDITIONS],
        F.lit(False).alias("product_compliance_assessed"))
    items = rules.select("rule_id", F.posexplode("conditions.evidence").alias("i", "e"))
    fields = rules.schema["conditions"].dataType["evidence"].dataType.elementType.names

    def field(name: str):
        column = F.col(f"e.{name}") if name in fields else F.lit(None)
        if name in ("appendix", "table"):
            return column.cast("string").alias("table_label" if name == "table" else name)
        return column.alias(name)

    evidence = items.select(
        name_uuid(prefix, "evidence", F.col("rule_id"), F.col("i")).alias("evidence_id"), "rule_id", *[field(n) for n in EVIDENCE])
    transitions = rules.where("conditions.transition is not null").select("rule_id", "conditions.transition.*")
    return {"ingredient_rules": flat, "rule_evidence": evidence, "rule_transitions": transitions}


def flatten_fragments(fragments: DataFrame, prefix: str = ID_PREFIX) -> dict[str, DataFrame]:
    """Documents, links, profiles, tags, references, relations and matches of source fragments."""
    kind = F.col("record_kind")
    docs = fragments.where(kind == "document_reference")
    profiles = fragments.where(kind == "additive_profile")
    links = [
        docs.select("fragment_id", F.lit(relation).alias("relation"), F.explode(F.array_distinct(column)).alias("url"))
        for column, relation in (("external_urls", "external"), ("file_urls", "file"))
    ]
    tags = [
        profiles.select("ingredient_id", F.lit(tag_type).alias("tag_type"), F.explode(F.array_distinct(column)).alias("t"))
        for column, tag_type in (("categories", "category"), ("origins", "origin"))
    ]
    doc_ids = docs.groupBy("url").agg(F.max("fragment_id").alias("document_id"))
    owners = profiles.groupBy("source_url").agg(F.max("ingredient_id").alias("related_ingredient_id"))
    references = profiles.select("ingredient_id", F.posexplode("references").alias("i", "r")).select(
        name_uuid(prefix, "reference", F.col("ingredient_id"), F.col("i")).alias("reference_id"), "ingredient_id", "r.*")
    relations = profiles.select("ingredient_id", F.explode(F.array_distinct("related_urls")).alias("related_url"))
    return {
        "documents": docs.select(F.col("fragment_id").alias("document_id"), "source_id", "title", "url", "verification_status", "fetched_at"),
        "document_links": links[0].unionByName(links[1]).select(
            name_uuid(prefix, "document_link", F.col("fragment_id"), F.col("relation"), F.col("url")).alias("link_id"),
            F.col("fragment_id").alias("document_id"), "relation", "url"),
        "ingredient_profiles": profiles.select(
            F.col("fragment_id").alias("profile_id"), "ingredient_id", "source_id", "source_url", "fetched_at", "has_article", "full_description_status"),
        "ingredient_tags": tags[0].unionByName(tags[1]).select(
            name_uuid(prefix, "tag", F.col("ingredient_id"), F.col("tag_type"), F.col("t.title"), F.col("t.url")).alias("tag_id"),
            "ingredient_id", "tag_type", F.col("t.title").alias("name"), F.col("t.url").alias("url")),
        "ingredient_references": references.join(doc_ids, "url", "left"),
        "ingredient_relations": relations.join(owners.withColumnRenamed("source_url", "related_url"), "related_url", "left").withColumn(
            "relation_id", name_uuid(prefix, "relation", F.col("ingredient_id"), F.col("related_url"))),
        "ingredient_matches": fragments.where(kind == "regulatory_match").select(
            "ingredient_id", F.col("legacy_id").alias("legacy_ingredient_id"), F.col("method").alias("match_method")),
    }


def remove_source(tables: dict[str, DataFrame], code: str, hosts: list[str], terms: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Take one source out: its references become null, its links go, other rows stay.

    Returns the tables and the violations (rules or evidence that depend on the source).
    """
    out = dict(tables)
    gone = F.coalesce(F.col("code") == code, F.lit(False)) | is_host_of(F.col("url"), hosts)
    excluded = tables["regulatory_sources"].where(gone).select("source_id", F.lit(True).alias("_gone"))
    out["regulatory_sources"] = tables["regulatory_sources"].where(~gone)
    found = [
        quality.violations(t, tables[t].join(excluded, "source_id"), "depends_on_excluded_source", F.col("rule_id"))
        for t in ("ingredient_rules", "rule_evidence")
    ]
    out["ingredients"] = tables["ingredients"].withColumns({
        c: clean_description(F.col(c), terms) for c in ("description", "full_description") if c in tables["ingredients"].columns})
    out["ingredient_aliases"] = tables["ingredient_aliases"].withColumn("source", F.when(F.col("source") != code, F.col("source")))
    for t in ("ingredient_profiles", "documents"):
        if t in tables:
            out[t] = tables[t].join(excluded, "source_id", "left").withColumn(
                "source_id", F.when(F.col("_gone").isNull(), F.col("source_id"))).drop("_gone").select(*tables[t].columns)
    for t, c in (("ingredient_profiles", "source_url"), ("documents", "url"), ("ingredient_tags", "url"),
                 ("ingredient_references", "url"), ("ingredient_relations", "related_url")):
        if t in out:
            out[t] = out[t].withColumn(c, F.when(~is_host_of(F.col(c), hosts), F.col(c)))
    if "document_links" in out:
        out["document_links"] = out["document_links"].where(~is_host_of(F.col("url"), hosts))
    if "ingredient_relations" in out:
        out["ingredient_relations"] = out["ingredient_relations"].where("related_ingredient_id is not null or related_url is not null")
    return out, quality.union_all(found)


def build_catalog(merged: dict[str, DataFrame], code: str, hosts: list[str], terms: list[str], prefix: str = ID_PREFIX):
    """Flat tables of a merged bundle without its secondary source, and their violations."""
    tables = {
        "regulatory_sources": merged["regulatory_sources"], "ingredients": merged["ingredients"],
        "ingredient_aliases": merged["ingredient_aliases"], **flatten_rules(merged["ingredient_rules"], prefix),
        **flatten_fragments(merged["source_fragments"], prefix),
    }
    unknown = merged["source_fragments"].where(~F.coalesce(F.col("record_kind").isin(*KINDS), F.lit(False)))
    tables, found = remove_source(tables, code, hosts, terms)
    return tables, quality.union_all([
        found, quality.violations("source_fragments", unknown, "unknown_kind", F.col("fragment_id")), catalog_violations(tables)])


def catalog_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """The catalog contract: unique ids, references, codes, rule completeness, profiles."""
    ids = {"ingredients": "ingredient_id", "ingredient_aliases": "alias_id", "ingredient_rules": "rule_id",
           "regulatory_sources": "source_id", "rule_evidence": "evidence_id", "documents": "document_id"}
    refs = {"ingredient_id": ("ingredients", "ingredient_id"), "related_ingredient_id": ("ingredients", "ingredient_id"),
            "rule_id": ("ingredient_rules", "rule_id"), "source_id": ("regulatory_sources", "source_id"),
            "document_id": ("documents", "document_id"), "entry_id": ("taxonomy_entries", "entry_id"),
            "parent_entry_id": ("taxonomy_entries", "entry_id")}
    parts = [quality.duplicate_keys(t, tables[t], k) for t, k in ids.items() if t in tables]
    for table, df in tables.items():
        for column, (target, key) in refs.items():
            if column in df.columns and table != target and target in tables:
                parts.append(quality.orphans(table, df, column, tables[target], key))
    parts.append(quality.code_rules(tables["ingredients"]))
    parts.append(quality.rule_completeness(tables["ingredient_rules"], tables["rule_evidence"], tables["rule_transitions"]))
    if "ingredient_profiles" in tables:
        lacking = tables["ingredients"].where("e_code is not null").join(tables["ingredient_profiles"].select("ingredient_id"), "ingredient_id", "left_anti")
        parts.append(quality.violations("ingredient_profiles", lacking, "missing_profile", F.col("ingredient_id")))
    return quality.union_all(parts)
