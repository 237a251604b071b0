"""Input tables derived from the driver's parquet files.

Every recipe is SQL that Spark and DuckDB both run. No recipe needs a window: positions are
packed from columns that are unique inside their key.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

DRIVER = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

DERIVED = {
    "ingredients": """
        SELECT p_partkey AS ingredient_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name,
          p_type || ' ' || p_name AS name_en,
          CASE WHEN p_partkey % 3 = 0 AND p_partkey < 9800 THEN 'E' || CAST(100 + p_partkey AS STRING) END AS e_code,
          p_type AS category, p_brand AS brand, p_size <> 7 AS is_active
        FROM part""",
    "aliases": """
        SELECT p_partkey AS ingredient_id, p_name || ' ' || CAST(p_partkey AS STRING) AS alias,
          lower(p_name || ' ' || CAST(p_partkey AS STRING)) AS normalized_alias, 'en' AS language,
          'catalog' AS source, 100 AS confidence
        FROM part
        UNION ALL
        SELECT p_partkey, p_name, lower(p_name), 'en', 'short', 90 FROM part WHERE p_partkey % 31 = 0
        UNION ALL
        SELECT p_partkey, 'old-' || CAST(p_partkey % 900 AS STRING), 'old ' || CAST(p_partkey % 900 AS STRING),
          'en', 'legacy_preference_id', 80 FROM part WHERE p_partkey % 13 = 0""",
    "alias_review": """
        SELECT p_partkey AS ingredient_id, p_name AS alias, lower(p_name) AS normalized_alias,
          'ambiguous_name' AS reason, 'short' AS source
        FROM part WHERE p_partkey % 197 = 0
        UNION ALL
        SELECT p_partkey, 'old-' || CAST(p_partkey % 700 AS STRING), 'old ' || CAST(p_partkey % 700 AS STRING),
          'ambiguous_name', 'legacy_preference_id' FROM part WHERE p_partkey % 199 = 0""",
    "matches": """
        SELECT p_partkey AS ingredient_id, 'old-' || CAST(p_partkey + 7 AS STRING) AS legacy_ingredient_id,
          'exact_e_code' AS match_method FROM part WHERE p_partkey % 11 = 0""",
    "sources": """
        SELECT DISTINCT p_partkey % 7 AS source_id, 'SRC_' || CAST(p_partkey % 7 AS STRING) AS code,
          'Source ' || CAST(p_partkey % 7 AS STRING) AS title,
          'https://acts.example.org/' || CAST(p_partkey % 7 AS STRING) AS url,
          CAST(NULL AS DATE) AS effective_from,
          CASE WHEN p_partkey % 7 = 6 THEN DATE '2022-12-31' END AS effective_to
        FROM part""",
    "rules": """
        SELECT p_partkey AS rule_id, p_partkey - p_partkey % 2 AS ingredient_id, p_partkey % 7 AS source_id,
          CASE p_size % 5 WHEN 0 THEN 'BANNED' WHEN 1 THEN 'PHASE_OUT' ELSE 'PERMITTED_WITH_CONDITIONS' END AS regulatory_status,
          CASE WHEN p_size % 7 = 0 THEN 'reference_only' ELSE 'notice' END AS evaluation,
          CASE WHEN p_size % 2 = 0 THEN 'exact_only' END AS match_policy,
          'Rule ' || CAST(p_partkey AS STRING) AS title,
          CASE WHEN p_size % 3 = 0 THEN 'About ' || p_name END AS explanation,
          CASE WHEN p_size % 9 = 0 THEN 'needs_review' ELSE 'verified_primary' END AS verification_status,
          CASE WHEN p_size % 8 = 0 THEN TRUE END AS primary_basis_required,
          CASE WHEN p_size % 10 = 0 THEN FALSE WHEN p_size % 10 = 1 THEN TRUE END AS production_ready,
          CASE WHEN p_size % 6 = 0 THEN DATE '2030-01-01' ELSE DATE '2020-01-01' END AS effective_from,
          CASE WHEN p_size % 11 = 0 THEN DATE '2023-06-30' END AS effective_to
        FROM part WHERE p_size % 4 <> 3""",
    "transitions": """
        SELECT p_partkey AS rule_id, DATE '2024-02-27' AS effective_from, 36 AS months,
          CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-12-31' ELSE DATE '2027-02-27' END AS transition_end
        FROM part WHERE p_size % 4 <> 3 AND p_size % 5 = 1""",
    "evidence": """
        SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_partkey AS rule_id, l_suppkey % 7 AS source_id,
          'page ' || CAST(l_linenumber AS STRING) AS locator, l_returnflag AS verification_status
        FROM lineitem WHERE l_linestatus = 'F'""",
    "tags": """
        SELECT l_partkey AS ingredient_id, CASE WHEN l_returnflag = 'N' THEN 'origin' ELSE 'category' END AS tag_type,
          'tag ' || CAST(l_suppkey AS STRING) AS name
        FROM lineitem WHERE l_linenumber = 1""",
    "label_tokens": """
        SELECT l_orderkey AS product_id,
          l_linenumber * 100000000000 + l_partkey AS pos,
          CASE l_linenumber % 5
            WHEN 0 THEN 'without E' || CAST(100 + p_partkey % 900 AS STRING)
            WHEN 1 THEN 'colour (E-' || CAST(100 + p_partkey % 900 AS STRING) || ')'
            WHEN 2 THEN p_name || ' ' || CAST(p_partkey AS STRING)
            WHEN 3 THEN upper(p_name)
            ELSE 'unknown ' || CAST(p_partkey AS STRING) END AS token
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "label_texts": """
        SELECT o_orderkey AS product_id, o_custkey AS user_id, o_orderdate AS scanned_at,
          p_name || ' ' || CAST(p_partkey AS STRING) || ', colour (E-' || CAST(100 + o_orderkey % 900 AS STRING)
            || ', ' || upper(p_name) || '); without E' || CAST(100 + o_custkey % 900 AS STRING)
            || CASE WHEN o_orderkey % 4 = 0 THEN ', unknown ' || CAST(o_orderkey AS STRING) ELSE ' ' END AS text
        FROM orders JOIN part ON o_custkey = p_partkey""",
    "exclusions": """
        SELECT c_custkey AS user_id, (c_custkey * 7) % 1000 AS ingredient_id FROM customer
        UNION
        SELECT c_custkey, (c_custkey * 13 + 5) % 1000 FROM customer""",
    "preferences": """
        SELECT c_custkey AS user_id, c_nationkey AS revision,
          CASE WHEN c_mktsegment = 'BUILDING' THEN TIMESTAMP '2024-01-01 00:00:00' END AS local_imported_at
        FROM customer WHERE c_nationkey % 5 <> 4""",
    "requested_ids": """
        SELECT c_custkey AS user_id, 'old-' || CAST(c_custkey % 1000 AS STRING) AS requested FROM customer
        UNION
        SELECT c_custkey, CAST(c_custkey % 2500 AS STRING) FROM customer""",
    "products": """
        SELECT o_orderkey AS product_id, o_custkey AS user_id, o_orderdate AS scanned_at FROM orders""",
    "lab_runs": """
        SELECT o_orderkey AS run_id, o_orderpriority AS mode, o_orderstatus AS protocol_version,
          o_custkey % 3 AS config_no, o_custkey % 50 AS case_id,
          CASE WHEN o_orderstatus = 'P' THEN 'running' ELSE 'finished' END AS status,
          CASE WHEN o_orderstatus = 'P' THEN 'timeout' WHEN o_custkey % 2 = 0 THEN 'valid_barcode' ELSE 'valid_ocr' END AS outcome,
          o_orderstatus <> 'P' AS valid_result, o_custkey % 17 = 0 AS excluded_from_analysis,
          o_custkey AS created_by, o_orderdate AS started_at, 10000 + o_custkey % 20000 AS run_max_ms
        FROM orders""",
    "lab_tasks": """
        SELECT l_orderkey AS run_id, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) * 10000 + l_suppkey AS task_no,
          CASE WHEN l_returnflag = 'R' THEN 'lookup' ELSE 'ocr' END AS kind,
          CASE WHEN l_linestatus = 'O' THEN 'running' ELSE 'finished' END AS status,
          CASE WHEN l_discount < 0.02 THEN NULL ELSE CAST(l_quantity AS BIGINT) END AS cpu_ms,
          CASE WHEN l_tax < 0.02 THEN NULL ELSE CAST(l_linenumber * 1000 AS BIGINT) END AS upload_bytes,
          CAST(l_quantity * 10 AS BIGINT) AS download_bytes,
          CASE WHEN l_discount < 0.01 THEN NULL ELSE CAST(l_quantity * 1024 AS BIGINT) END AS rss_bytes,
          l_discount > 0.03 AS sufficient, l_shipdate AS requested_at
        FROM lineitem""",
    "lab_events": """
        SELECT user_id AS run_id, CASE WHEN event_id % 10 = 9 THEN 'server' ELSE 'browser' END AS source, event_id AS seq,
          CASE event_type WHEN 'view' THEN 'frame_considered' WHEN 'click' THEN 'frame_selected' WHEN 'error' THEN 'frame_rejected'
            WHEN 'signup' THEN 'camera_ready' ELSE 'result_displayed' END AS event_name,
          ts, value AS relative_ms, props AS details
        FROM events""",
    "frames": """
        SELECT CAST(label AS BIGINT) AS run_id, vec_id AS frame_no, embedding AS fp FROM embeddings""",
    "stage_actions": """
        SELECT conv_id AS run_id, turn AS revision, CASE turn % 7 WHEN 0 THEN 'start_manual' WHEN 1 THEN 'finish_manual'
          WHEN 2 THEN 'start_app' WHEN 3 THEN 'finish_app' WHEN 4 THEN 'annotate' WHEN 5 THEN 'save_app' ELSE 'abort' END AS action,
          role AS actor FROM conversations""",
    "study_runs": """
        SELECT o_orderkey AS run_id, o_custkey % 25 AS study_id, o_custkey AS participant_id, o_custkey % 100 AS case_id,
          CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'aborted' ELSE 'app_active' END AS stage,
          o_orderdate AS created_at FROM orders""",
    "study_photos": """
        SELECT l_orderkey AS run_id, l_partkey AS photo_id FROM lineitem WHERE l_returnflag = 'A'""",
    "study_attempts": """
        SELECT l_orderkey AS run_id, (CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) * 10000 + l_suppkey AS attempt_id,
          CASE l_returnflag WHEN 'R' THEN 'needs_retake' WHEN 'A' THEN 'error' ELSE 'success' END AS ocr_status,
          CASE WHEN l_linestatus = 'O' THEN 'processing' ELSE 'success' END AS status,
          CASE WHEN l_linenumber = 3 THEN ' ' ELSE 'E' || CAST(100 + l_partkey % 900 AS STRING) || ', salt' END AS composition,
          l_partkey AS ingredient_id, CAST(l_quantity * 100 AS BIGINT) AS server_ms,
          CASE WHEN l_linestatus = 'F' AND l_tax > 0.04 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS e2e_ms
        FROM lineitem""",
    "study_validations": """
        SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN 'confirmed' ELSE 'unreviewed' END AS status,
          o_custkey % 4 AS revision, CASE WHEN o_custkey % 6 = 0 THEN '' ELSE 'label ' || o_orderstatus END AS verified_text FROM orders""",
    "studies": """SELECT n_nationkey AS study_id, n_name AS study_title FROM nation""",
    "cases": """
        SELECT DISTINCT o_custkey % 100 AS case_id, 'Case ' || CAST(o_custkey % 100 AS STRING) AS case_title FROM orders""",
    "words": """
        SELECT l_orderkey AS page_no, l_linenumber AS line_no, l_partkey AS word_no,
          CASE WHEN l_tax < 0.01 THEN ' ' ELSE 'w' || CAST(l_partkey AS STRING) END AS word,
          CASE WHEN l_discount = 0.0 THEN CAST(-1 AS BIGINT) ELSE CAST(floor(l_extendedprice) AS BIGINT) % 100 END AS conf,
          CAST(l_quantity AS BIGINT) AS height
        FROM lineitem""",
}

_NAME = re.compile(r"\b(" + "|".join(sorted(DERIVED, key=len, reverse=True)) + r")\b(?!\s*\.)")


def duck_sql(sql: str) -> str:
    """The query with the recipes of the derived tables it names put in front."""
    names = [n for n in DERIVED if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql, re.I)]
    if not names:
        return sql.strip()
    head = ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


class Tables:
    """Lazy access to driver and derived tables: ``t.orders``, ``t.ingredients``..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in DERIVED:
            return self.sql(DERIVED[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run recipe SQL directly on the parquet files, so filters and columns reach the scan."""
        files = re.sub(
            rf"\b(FROM|JOIN)\s+({'|'.join(DRIVER)})\b", lambda m: f"{m[1]} parquet.`{self.dir}/{m[2]}.parquet`", text
        )
        return self.spark.sql(files)


@lru_cache(maxsize=1)
def derived_names() -> tuple[str, ...]:
    return tuple(DERIVED)
