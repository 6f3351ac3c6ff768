"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The derived mails and documents are stored once before timing, so the figures are those of the
engine.  Each query runs BENCH_RUNS times after BENCH_WARMUPS untimed runs; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from freightaudit.bindings import feature_queries, score_queries, views
from freightaudit.operators import evaluate, review, rules
from freightaudit.plans import audit
from freightaudit.sources.sinks import local_shared_folder, stored


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("freightaudit-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    local_shared_folder(spark)
    parts = 4 * int(cpus)
    mails = stored(views.mails(spark, sf_dir).repartition(parts))
    docs = stored(views.documents(spark, sf_dir).repartition(parts))
    truth, pred = (stored(views.view(spark, sf_dir, v)) for v in ("v_truth", "v_pred"))
    log = review.override_log(views.view(spark, sf_dir, "v_actions"))

    queries = {
        "audit_mails": lambda: audit.decisions(audit.audit_mails(mails, docs)),
        "classify_by_rules": lambda: rules.classify_by_rules(mails).drop("scores"),
        "final_score": lambda: evaluate.final_score(evaluate.join_truth_outer(truth, pred)),
        "category_report": lambda: evaluate.category_report(
            evaluate.join_truth_outer(truth, pred)
        ),
        "review_queue": lambda: review.review_queue(
            review.join_override(pred, review.latest_override(log)), True
        ),
        "low_confidence": lambda: review.low_confidence(pred),
        "stratified_folds": lambda: feature_queries.stratified_folds(spark, sf_dir),
        "word_tfidf": lambda: feature_queries.word_tfidf(spark, sf_dir),
        "char_wb_tfidf": lambda: feature_queries.char_wb_tfidf(spark, sf_dir),
        "confusion": lambda: score_queries.confusion(spark, sf_dir),
    }
    times = {name: timed(name, build, runs) for name, build in queries.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "mails_per_second": round(mails.count() / times["audit_mails"]),
            }
        )
    )
    spark.stop()


def run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def timed(name: str, build, runs: int) -> float:
    for _ in range(int(os.environ.get("BENCH_WARMUPS", "0"))):
        run(build())
    took = []
    for _ in range(runs):
        start = time.perf_counter()
        run(build())
        took.append(time.perf_counter() - start)
    print(f"{name}: {took}", file=sys.stderr, flush=True)
    return statistics.median(took)


if __name__ == "__main__":
    main()
