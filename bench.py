"""Headline queries, timed: prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from graphloom.queries import QUERIES

#: Each stands for a shape that the baseline times: scan, two- and three-pattern joins by each strategy, and the load.
HEADLINE = ("tp_p", "sel_land", "join_star", "hjoin_star", "mjoin_star", "join_path", "hjoin_path", "mjoin_path", "join_chain", "join_bushy", "optional_orders", "pred_freq", "dict_roundtrip")
REPEATS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, rows = {}, {}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            frame = QUERIES[name](spark, folder)
            frame.write.format("noop").mode("overwrite").save()  # all rows and columns, decoded
            times.append(time.perf_counter() - began)
        rows[name] = frame.count()
        found[name] = round(statistics.median(times), 4)
    middle = sorted(found.values())[1:-1]
    print(json.dumps({"metric": "graph-pattern queries, sum of medians", "value": round(sum(found.values()), 4), "unit": "sec", "queries": found, "rows": rows, "average": round(sum(found.values()) / len(found), 4), "middle_average": round(sum(middle) / len(middle), 4), "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
