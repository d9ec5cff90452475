"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ["in_degree_dist", "out_degree_dist", "topk_in_degree_names", "topk_out_degree_names", "topk_value_names", "undirect_edges", "pagerank_5", "wcc_size_dist", "closeness_4", "linerank_5", "pagerank_5_sparse", "wcc_size_dist_sparse", "closeness_4_sparse", "linerank_5_sparse"]


def main() -> None:
    from pyspark.sql import SparkSession

    from arcweave.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{tempfile.gettempdir()}/arcweave-warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["out_degree"](spark, sf_dir).count()  # warm up
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
