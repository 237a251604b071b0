"""Data-quality rules. Every function returns violation rows (rule, table_name, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from provisor.functions.codes import letter_count, strict_code
from provisor.functions.text import normalize_text

VIOLATION = "rule string, table_name string, key string, detail string"
UUID_FORM = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

# Allowed values of catalog columns.
STATUSES = ("PERMITTED_WITH_CONDITIONS", "BANNED", "PHASE_OUT")
EVALUATIONS = ("reference_only", "notice")
TAG_TYPES = ("category", "origin")
REVIEW_REASONS = ("ambiguous_name", "e_code_mismatch", "empty_normalized_alias", "name_fragment")
EXCLUSION_REASONS = (
    "wrong_product", "bad_setup", "operator_mistake", "duplicate_trial", "instrumentation_error", "other",
)
CODE_COLUMN = r"(?i)^E[0-9]{3,4}[a-z]?(\([ivx]+\))?$"


def violations(table: str, rows: DataFrame, rule: str, key: Column, detail: Column | None = None) -> DataFrame:
    detail = F.lit(None) if detail is None else detail
    return rows.select(
        F.lit(rule).alias("rule"), F.lit(table).alias("table_name"), key.cast("string").alias("key"),
        detail.cast("string").alias("detail"),
    )


def failing_rows(table: str, df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Check many expressions in one pass; a rule holds unless its expression is false."""
    failed = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()
    ]))
    return df.select(F.explode(failed).alias("rule"), F.col(key).alias("_key")).select(
        "rule", F.lit(table).alias("table_name"), F.col("_key").cast("string").alias("key"),
        F.lit(None).cast("string").alias("detail"),
    )


def duplicate_keys(table: str, df: DataFrame, key: str | Column, rule: str = "duplicate_id") -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    counts = df.select(key.alias("_key")).where("_key is not null").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    return violations(table, counts.where("_n > 1"), rule, F.col("_key"), F.col("_n"))


def orphans(table: str, df: DataFrame, column: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """References without a target; a null reference is allowed."""
    have = parents.select(F.col(parent_key).alias("_ref"))
    lost = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_ref")).join(have, "_ref", "left_anti")
    return violations(table, lost, f"orphan_{column}", F.col("_ref"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key_set_difference(rule: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two key sets must be equal: rows for keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return union_all([
        violations(rule, a.join(b, key, "left_anti"), "only_left", F.col(key)),
        violations(rule, b.join(a, key, "left_anti"), "only_right", F.col(key)),
    ])


def key_set_overlap(rule: str, left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two key sets must be disjoint: rows for keys both sides have."""
    shared = left.select(key).intersect(right.select(key))
    return violations(rule, shared, "overlap", F.col(key))


def column_contract(table: str, df: DataFrame, expected: list[str], flat: bool = True) -> DataFrame:
    """Missing, unexpected and (in flat tables) nested columns; reads the schema only."""
    nested = [] if not flat else [f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")]
    found = (
        [("missing_column", c) for c in expected if c not in df.columns]
        + [("unexpected_column", c) for c in df.columns if c not in expected]
        + [("nested_column", c) for c in nested]
    )
    spark = df.sparkSession
    rows = [(rule, table, name, None) for rule, name in found]
    return spark.createDataFrame(rows, VIOLATION)


def identifier_form(table: str, df: DataFrame, key: str) -> DataFrame:
    columns = [c for c in df.columns if c == "id" or c.endswith("_id")]
    return failing_rows(table, df, key, {
        f"not_uuid_{c}": F.col(c).isNull() | F.lower(F.col(c).cast("string")).rlike(UUID_FORM) for c in columns
    })


def code_rules(ingredients: DataFrame, key: str = "ingredient_id") -> DataFrame:
    """Codes are valid and unique; only ordinary ingredients go without one."""
    code = strict_code(F.col("e_code"))
    checks = {"invalid_code": F.col("e_code").isNull() | code.isNotNull()}
    if "kind" in ingredients.columns:
        has_code = F.coalesce(F.col("e_code"), F.lit("")) != ""
        checks["code_required"] = has_code | F.col("kind").eqNullSafe("ingredient")
    return union_all([
        failing_rows("ingredients", ingredients, key, checks),
        duplicate_keys("ingredients", ingredients, code, "duplicate_code"),
    ])


def rule_completeness(rules: DataFrame, evidence: DataFrame, transitions: DataFrame) -> DataFrame:
    """Status domain, required fields, evidence for every rule, transitions exactly for phase-outs."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    checks = {
        "status_domain": F.col("regulatory_status").isin(*STATUSES) & F.col("regulatory_status").isNotNull(),
        "identity": filled("ingredient_id") & filled("source_id") & filled("verification_status"),
    }
    if "product_compliance_assessed" in rules.columns:
        checks["compliance_inferred"] = F.col("product_compliance_assessed").eqNullSafe(F.lit(False))
    fields = {f"evidence_{c}": filled(c) for c in ("url", "locator", "verification_status") if c in evidence.columns}
    phase_out = rules.where("regulatory_status = 'PHASE_OUT'")
    return union_all([
        failing_rows("ingredient_rules", rules, "rule_id", checks),
        failing_rows("rule_evidence", evidence, "rule_id", fields),
        key_set_difference("evidence_of_rules", evidence, rules, "rule_id"),
        key_set_difference("transitions_of_phase_outs", transitions, phase_out, "rule_id"),
    ])


def ordered_dates(start: str = "effective_from", end: str = "effective_to") -> Column:
    return F.col(end).isNull() | F.col(start).isNull() | (F.col(end) >= F.col(start))


def domain_rules() -> dict[str, dict[str, Column]]:
    """Column domains and date orders per catalog table."""
    c = F.col
    return {
        "regulatory_sources": {"date_order": ordered_dates()},
        "ingredients": {"code_form": c("e_code").rlike(CODE_COLUMN)},
        "ingredient_aliases": {"confidence_range": c("confidence").between(0, 1)},
        "ingredient_alias_review": {
            "confidence_range": c("confidence").between(0, 1), "reason_domain": c("reason").isin(*REVIEW_REASONS)},
        "ingredient_rules": {
            "status_domain": c("regulatory_status").isin(*STATUSES),
            "evaluation_domain": c("evaluation").isin(*EVALUATIONS),
            "policy_domain": c("match_policy") == "exact_only",
            "compliance_inferred": ~c("product_compliance_assessed"),
            "date_order": ordered_dates()},
        "rule_evidence": {"page_positive": c("pdf_page") > 0},
        "rule_transitions": {
            "months_positive": c("months") > 0,
            "end_after_start": c("transition_end") >= c("effective_from"),
            "production_before_end": c("last_production_date") < c("transition_end")},
        "ingredient_tags": {"type_domain": c("tag_type").isin(*TAG_TYPES)},
    }


def alias_owners(ingredients: DataFrame, aliases: DataFrame) -> DataFrame:
    """(normal form, owner) over aliases and both canonical names, without repeats."""
    parts = [aliases.select(normalize_text(F.col("alias")).alias("form"), "ingredient_id")]
    for column in ("name", "name_en"):
        named = ingredients.where(F.coalesce(F.col(column), F.lit("")) != "")
        parts.append(named.select(normalize_text(F.col(column)).alias("form"), "ingredient_id"))
    return union_all(parts).distinct()


def ambiguous_forms(owners: DataFrame) -> DataFrame:
    """Normal forms with more than one owner and how many."""
    counts = owners.groupBy("form").agg(F.count(F.lit(1)).alias("owners"))
    return counts.where("owners > 1")


def ambiguity_report(owners: DataFrame, ingredients: DataFrame) -> DataFrame:
    """One row per candidate owner of an ambiguous name; long, so no name grows one row."""
    found = owners.join(ambiguous_forms(owners).select("form"), "form")
    return found.join(ingredients.select("ingredient_id", "name", "e_code"), "ingredient_id").select(
        "form", "ingredient_id", "name", "e_code"
    )


def matching_safety(ingredients: DataFrame, aliases: DataFrame, review: DataFrame) -> DataFrame:
    """Active aliases that are empty, stale, ambiguous, under review, of another code or fragments."""
    form = normalize_text(F.col("alias"))
    ambiguous = ambiguous_forms(alias_owners(ingredients, aliases)).select("form", F.lit(True).alias("_many"))
    reviewed = review.select(F.col("normalized_alias").alias("form")).distinct().withColumn("_review", F.lit(True))
    codes = ingredients.select("ingredient_id", strict_code(F.col("e_code")).alias("_own"))
    rows = (
        aliases.withColumn("form", form).withColumn("_code", strict_code(F.col("alias")))
        .join(ambiguous, "form", "left").join(reviewed, "form", "left").join(codes, "ingredient_id", "left")
        .withColumn("_key", F.concat_ws("/", F.col("ingredient_id").cast("string"), "alias"))
    )
    return failing_rows("ingredient_aliases", rows, "_key", {
        "empty": F.col("form") != "",
        "stale_normal_form": F.col("form") == F.col("normalized_alias"),
        "ambiguous": F.col("_many").isNull(),
        "under_review": F.col("_review").isNull(),
        "other_code": F.col("_code").isNull() | F.col("_code").eqNullSafe(F.col("_own")),
        "fragment": F.col("_code").isNotNull() | (letter_count(F.col("form")) >= 2),
    })


def experiment_config_rules() -> dict[str, Column]:
    """Thresholds come in order and stay inside the run's time."""
    c = F.col
    return {
        "hint_before_barcode": c("photo_hint_ms") < c("barcode_max_ms"),
        "barcode_before_end": c("barcode_max_ms") < c("run_max_ms"),
        "hedge_before_barcode": c("ocr_hedge_ms") < c("barcode_max_ms"),
        "lookup_before_end": c("lookup_max_ms") < c("run_max_ms"),
        "barcode_range": c("barcode_max_ms").between(500, 15000),
        "hint_range": c("photo_hint_ms").between(0, 14000),
        "hedge_range": c("ocr_hedge_ms").between(0, 14000),
        "lookup_range": c("lookup_max_ms").between(500, 15000),
        "run_range": c("run_max_ms").between(10000, 120000),
        "interval_range": c("frame_min_interval_ms").between(1000, 10000),
        "requests_range": c("max_ocr_requests").between(1, 3),
    }


def reference_list_rules(items: str = "reference_ingredients") -> dict[str, Column]:
    """At most 100 items of 1 to 160 characters, unique without case."""
    trimmed = F.transform(items, lambda v: F.btrim(v))
    folded = F.transform(trimmed, lambda v: F.lower(v))
    return {
        "reference_size": F.size(items) <= 100,
        "reference_length": F.forall(trimmed, lambda v: F.length(v).between(1, 160)),
        "reference_unique": F.size(F.array_distinct(folded)) == F.size(items),
    }


def review_rules() -> dict[str, Column]:
    return {"indices_unique": F.size(F.array_distinct("matched_indices")) == F.size("matched_indices"),
            "indices_size": F.size("matched_indices") <= 100}


def exclusion_rules() -> dict[str, Column]:
    """An exclusion names its reason, the reason 'other' a comment; a restore carries neither."""
    c, filled = F.col, lambda n: F.coalesce(F.btrim(F.col(n)), F.lit("")) != ""
    return {
        "reason_domain": c("reason").isin(*EXCLUSION_REASONS),
        "exclusion_documented": ~c("excluded") | (filled("reason") & ((c("reason") != "other") | filled("comment"))),
        "restore_bare": c("excluded") | ~(filled("reason") | filled("comment")),
    }


def correction_rules(items: DataFrame) -> DataFrame:
    """Bounds of correction requests: 1-50 items, unique ids and positions, 1-500 characters.

    ``items`` has one row per correction: request_id, id, token_index, token_raw, corrected_text.
    """
    length = F.length(F.btrim("corrected_text"))
    per_item = failing_rows("corrections", items, "request_id", {
        "text_length": length.between(1, 500),
        "index_range": F.col("token_index").between(0, 1000),
        "raw_length": F.length(F.btrim("token_raw")) <= 4000,
    })
    counts = items.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    twice = [
        items.groupBy("request_id", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("request_id").distinct()
        for c in ("id", "token_index")
    ]
    return union_all([
        per_item,
        violations("corrections", counts.where("n > 50"), "too_many_items", F.col("request_id"), F.col("n")),
        violations("corrections", twice[0], "duplicate_item_id", F.col("request_id")),
        violations("corrections", twice[1], "duplicate_token_index", F.col("request_id")),
    ])


def dataset_violations(metadata: DataFrame, tables: dict[str, DataFrame], rule_sets: dict, default) -> DataFrame:
    """Violations by the rule set that ``metadata.dataset`` names, else by ``default``.

    A rule set is a function of the tables. Only the distinct names reach the driver; a bundle
    with several names is judged by each of their rule sets.
    """
    names = [r["dataset"] for r in metadata.select("dataset").distinct().collect()] or [None]
    chosen = {id(rules): rules for rules in (rule_sets.get(n, default) for n in sorted(names, key=str))}
    return union_all([rules(tables) for rules in chosen.values()])


def require_clean(found: DataFrame) -> None:
    """Guard with an action: fail when any violation exists, naming a few."""
    sample = found.limit(5).collect()
    if sample:
        raise ValueError("data quality: " + "; ".join(f"{r.rule} in {r.table_name}: {r.key}" for r in sample))
