"""Times the headline queries once warm; prints one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from ledgerline import Engine
from ledgerline import queries as engine_queries

HEADLINE = ("count_all", "count_filtered", "filter_gt_numeric", "filter_nested", "group_avg", "group_multi_key", "global_sum", "top_k", "distinct_count")
RUNS = 5


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = engine_queries.queries()
    engine = Engine(spark, index_dir=engine_queries.scratch(spark, "bench"))
    engine.create_index(f"{sf}/orders.parquet", ["o_orderkey"])  # warm
    took = []
    for _ in range(3):
        began = time.perf_counter()
        engine.create_index(f"{sf}/lineitem.parquet", ["l_orderkey"])
        took.append(time.perf_counter() - began)
    times = {"index_build": statistics.median(took)}
    runs = {k: (lambda f=found[k]: f(spark, sf)) for k in HEADLINE}
    runs["lookup_indexed"] = lambda: engine.find(f"{sf}/lineitem.parquet").where({"l_orderkey": 4242}).all()
    runs["lookup_scan"] = lambda: Engine(spark).find(f"{sf}/lineitem.parquet").where({"l_orderkey": 4242}).all()
    for name, run in runs.items():
        run().write.format("noop").mode("overwrite").save()  # warm
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = statistics.median(took)
    spark.stop()
    print(json.dumps({"metric": "total of medians", "value": round(sum(times.values()), 4), "unit": "sec", "queries": {k: round(v, 4) for k, v in times.items()}, "sf": float(sf.rstrip("/").rpartition("sf")[2]) if "sf" in sf.rpartition("/")[2] else None}))


if __name__ == "__main__":
    main()
