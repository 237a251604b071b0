"""Python functions must run on workers that cannot import the package by themselves."""

import os
import pathlib
import subprocess
import sys
import tempfile

REPO = pathlib.Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config(
    "spark.checkpoint.dir", {shared!r}).config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__ as entry
queries = entry.queries()
for name in ("src_6_tags", "src_8_reading_notes", "str_6_throttled_hits", "win_6_selected_frames"):
    found = [n for n in queries if n.startswith(name[:5]) and n == name]
    for n in found:
        print("RAN", n, queries[n](spark, "/root/testdata/sf0.001").count() > 0, flush=True)
"""


def test_queries_run_from_another_folder():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=str(REPO), shared=folder)
    done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    ran = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("RAN")]
    assert len(ran) >= 4 and all(ok == "True" for _, ok in ran), done.stdout[-2000:] + done.stderr[-3000:]


def test_label_tasks_stay_small(spark):
    """Labels of one exchange were merged into tasks of 64 MB of compressed text, whose tokens need gigabytes."""
    from pyspark.sql import functions as F

    from provisor.operators import resolve

    texts = spark.range(400_000).select(F.col("id").alias("product_id"), F.concat_ws(", ", *[F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(3)]).alias("text"))
    tokens = resolve.with_lookup_key(resolve.label_tokens(texts.repartition("product_id")))
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) <= 4 << 20
    sizes = [r.n for r in tokens.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("product_id").alias("n")).collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 40_000
