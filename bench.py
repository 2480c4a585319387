"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

# Detection over text, the policy decision for every finding, redaction, the ledger,
# sessions, and evaluation.
HEADLINE = (
    "verdicts_by_source",
    "detect_all_documents",
    "scan_distinct_texts",
    "detect_credentials",
    "detect_context",
    "detect_encoded",
    "classify_documents_corpus",
    "policy_decide",
    "request_actions",
    "judge_documents",
    "verify_redaction",
    "append_chain",
    "verify_ledger",
    "resolve_actors",
    "flatten_spans",
    "session_risk",
    "detector_quality",
    "finding_distributions",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tarnhelm.plans import registry

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Without call-site capture the driver builds large expressions several times
        # faster.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    only = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in only:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, chars = docs.selectExpr("count(*)", "sum(n_chars)").first()
    line = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if "detect_all_documents" in times:
        t = times["detect_all_documents"]
        line["scan_records_per_sec"] = round(n / t, 1)
        line["scan_mb_per_sec"] = round(chars / t / 1e6, 2)
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
