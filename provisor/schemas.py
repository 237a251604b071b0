"""Fixed schemas of the flat catalog bundle and of product records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

BUNDLE_VERSION = 2

# Column names of the catalog bundle, table by table.
BUNDLE_COLUMNS = {
    "regulatory_sources": "id code title url version_date effective_from effective_to",
    "ingredients": "id kind e_code canonical_name_ru canonical_name_en category description full_description is_active",
    "ingredient_aliases": "id ingredient_id alias normalized_alias language source confidence",
    "ingredient_rules": "id ingredient_id source_id regulatory_status title explanation citation scope jurisdiction verification_status evaluation match_policy primary_basis_required production_ready product_compliance_assessed effective_from effective_to",
    "rule_evidence": "id rule_id source_id url locator document_role verification_status pdf_page appendix table_label",
    "rule_transitions": "rule_id effective_from months last_production_date transition_end boundary_basis requires_preexisting_conformity_documents legacy_circulation_until_expiry",
    "ingredient_profiles": "id ingredient_id source_id source_url fetched_at has_article full_description_status",
    "ingredient_tags": "id ingredient_id tag_type name_ru url",
    "documents": "id source_id title url verification_status fetched_at",
    "document_links": "id document_id relation url",
    "ingredient_references": "id ingredient_id document_id title url relation organization",
    "ingredient_relations": "id ingredient_id related_ingredient_id related_url",
    "ingredient_matches": "ingredient_id legacy_ingredient_id match_method",
    "taxonomy_sources": "id code title url file_sha256",
    "taxonomy_entries": "id taxonomy_source_id taxonomy_key canonical_name_ru canonical_name_en ingredient_id match_method source_line",
    "taxonomy_parents": "id entry_id parent_entry_id parent_reference",
    "taxonomy_properties": "id entry_id property language value verification_status",
    "ingredient_alias_review": "id ingredient_id alias normalized_alias language source confidence reason",
}
BOOLEANS = {
    "is_active", "primary_basis_required", "production_ready", "product_compliance_assessed", "has_article",
    "requires_preexisting_conformity_documents", "legacy_circulation_until_expiry",
}
INTEGERS = {"months", "pdf_page", "source_line"}

# The product fields that are read.
PRODUCT_SCHEMA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("code", "product_name", "generic_name", "brands", "quantity", "categories")],
    T.StructField("categories_tags", T.ArrayType(T.StringType())),
    T.StructField("ingredients", T.StringType()),
    T.StructField("ingredients_text", T.StringType()),
    *[T.StructField(n, T.ArrayType(T.StringType())) for n in ("additives_tags", "additives_original_tags", "ingredients_analysis_tags")],
    *[T.StructField(n, T.StringType()) for n in ("allergens", "nutriments", "image_front_url")],
])


def bundle_type(name: str) -> T.DataType:
    if name in BOOLEANS:
        return T.BooleanType()
    if name in INTEGERS:
        return T.IntegerType()
    if name == "confidence":
        return T.DecimalType(3, 2)
    return T.StringType()


def table_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, bundle_type(c)) for c in BUNDLE_COLUMNS[table].split()])


def bundle_schema() -> T.StructType:
    meta = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("schema_version", T.IntegerType())])
    return T.StructType(
        [T.StructField("metadata", meta)] + [T.StructField(t, T.ArrayType(table_schema(t))) for t in BUNDLE_COLUMNS])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Allow-list projection: known columns in order, missing ones null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(table)
    ])


# Names used by the operators; everything else keeps its bundle name.
OPERATOR_NAMES = {
    "ingredients": {"id": "ingredient_id", "canonical_name_ru": "name", "canonical_name_en": "name_en"},
    "ingredient_aliases": {"id": "alias_id"}, "ingredient_alias_review": {"id": "alias_id"},
    "regulatory_sources": {"id": "source_id"}, "ingredient_rules": {"id": "rule_id"}, "rule_evidence": {"id": "evidence_id"},
    "ingredient_tags": {"id": "tag_id", "name_ru": "name"},
}


def to_operator_names(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: df.withColumnsRenamed(OPERATOR_NAMES.get(t, {})) for t, df in tables.items()}


def to_bundle_names(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: df.withColumnsRenamed({v: k for k, v in OPERATOR_NAMES.get(t, {}).items()}) for t, df in tables.items()}
