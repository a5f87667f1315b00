"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from joinseek.plans.registry import QUERIES

# Without column_combinations: over 240 s at sf0.1 since it reads lineitem, see the README.
HEADLINE = [
    "profile_orders",
    "category_groups",
    "name_jaro",
    "semantic_similarity",
    "similar_columns",
    "unique_keys",
    "unique_keys_composite",
    "foreign_keys",
    "same_category_pairs",
    "overlap_jaccard",
    "overlap_merge",
    "sorted_neighbourhood",
    "sorted_neighbourhood_exact",
    "join_contribution",
    "counter_columns",
    "discover_orders_customer",
    "discover_lake",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("joinseek-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="joinseek-bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["table_shapes"](spark, folder).collect()  # start the session's workers
    seconds = {}
    for name in HEADLINE:
        # The first run plans and compiles; the second is timed.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
