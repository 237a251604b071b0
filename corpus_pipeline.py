"""The corpus pipeline: quality, repeated lines, near duplicates, mixture, packing.

``STAGES`` holds (name, function) pairs; a function takes (spark, docs, sf_dir) and returns the
next table, which is written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from provisor.llm.common import key_bits, maybe_in, shielded
from provisor.llm.jaccard import similar_sets
from provisor.llm.lines import remove_repeated_lines
from provisor.llm.mixing import mixed
from provisor.llm.packing import pack_documents
from provisor.llm.quality import keep_good
from provisor.session import cut_lineage, scratch


def quality(spark, docs, sf_dir):
    """Documents that the co-trained classifier keeps."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """Documents without lines that an earlier place has, exactly or nearly."""
    return remove_repeated_lines(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document, the smallest doc_id, of each group with five-word similarity 0.8.

    Rows without doc_id and empty texts stay; rows that share the kept doc_id stay together. Other
    columns may have any names; an empty table gives none.
    """
    docs, names = shielded(docs, "doc_id", "text")
    with scratch(spark) as own:
        late = own.keep(similar_sets(docs, 5, 80).where("component_id < doc_id").select(F.col("doc_id").alias("_late")), "late")
    marked = maybe_in(docs, F.col("doc_id"), key_bits(late, "_late"), "_maybe")
    checked = marked.where("_maybe").join(late, F.col("doc_id") == F.col("_late"), "left_anti")
    return checked.select(*docs.columns).unionAll(marked.where("not _maybe").select(*docs.columns)).toDF(*names)


def mixture(spark, docs, sf_dir):
    """Sources by weight 5, 2, 1, repeating; a document stands as often as it is taken."""
    return mixed(docs)


def packing(spark, docs, sf_dir):
    """Token pieces with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", packing)]
# A trained classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
