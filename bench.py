"""Wall-clock time of the headline queries; prints one JSON line.

Each query runs once to warm up and is then timed; results go to a sink that keeps nothing.
BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS and BENCH_QUERIES (comma-separated) change the defaults.

The given documents are one file with one row group, which one core would have to read and clean alone. Before any
clock starts they are dealt into a file for each core (BENCH_DEAL=0 leaves them as they are); the other tables are linked.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillbar.plans import catalog
from quillbar.session import local_session

HEADLINE = [
    "technical_indicators_wide", "technical_indicators_ticks", "rsi_14_frame", "label_rows", "label_rows_ticks",
    "headline_bar_join", "time_split", "clean_text", "tokenize", "preprocess_text", "entity_flags",
    "lexicon_polarity", "valence_compound", "model_nb", "clf_macro", "rank_metrics_ticks", "model_comparison",
    "strategy_metrics_ticks", "equity_curve_ticks", "bootstrap_ci", "feature_table", "baseline_comparison",
]


def timed(spark, sf_dir, name):
    start = time.perf_counter()
    catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def dealt(spark, sf_dir):
    """A folder with the same tables, the documents in as many files as there are cores."""
    folder = os.path.join(tempfile.mkdtemp(prefix="bench-"), os.path.basename(sf_dir.rstrip("/")))
    os.makedirs(folder)
    for name in sorted(os.listdir(sf_dir)):
        if name == "documents.parquet":
            spark.read.parquet(f"{sf_dir}/{name}").repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(os.path.abspath(f"{sf_dir}/{name}"), f"{folder}/{name}")
    return folder


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session()
    if os.environ.get("BENCH_DEAL", "1") != "0":
        sf_dir = dealt(spark, sf_dir)
    seconds = {}
    for name in names:
        timed(spark, sf_dir, name)
        seconds[name] = round(statistics.median(timed(spark, sf_dir, name) for _ in range(runs)), 3)
    print(json.dumps({"metric": "total time of the headline queries, warm", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
