"""Headline queries at one size, each the median of three runs after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from passagemill import queries
from passagemill.session import ship

RUNS = 3
HEADLINE = [
    "atomize_default", "sentence_count", "adjacent_similarity_lex", "similarity_stats", "boundary_candidates", "form_chunks", "chunk_ids",
    "fallback_keywords", "question_coverage", "approx_tokens", "paragraph_sample", "text_paragraphs_conv", "adjacent_similarity_vec", "run_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    took = {}
    for name in ["flagship", *HEADLINE]:
        query = queries.flagship if name == "flagship" else queries.QUERIES[name]
        runs = []
        for _ in range(1 + RUNS):
            began = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
