"""Times the headline queries and prints one line of JSON."""

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = (
    "question_stats collection_stats completed_collections evaluate_achievements attempts_with_latest player_stats collection_counts "
    "connected_components shortest_path_steps audit_nurimaze audit_shakashaka audit_pencils reconcile_overlaps stream_unlocks"
).split()
#: Training-data operators that are timed, too.
OPERATORS = ("op4_", "op9_", "op11_", "op12_", "op13_")


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entry = importlib.import_module("__spark_entry__")
    queries, took = entry.queries(), {}
    names = [n for n in HEADLINE if n in queries] + [n for n in queries if n.startswith(OPERATORS)]
    for name in names:
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compile and warm up
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
