"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one line of JSON."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from caseweave import catalog

HEADLINE = ["det1_communication_burst", "det2_circular_flow", "det6_co_location", "agg2_edge_roll_up", "gra12_components", "gra3_betweenness", "gra4_eigenvector", "sim6_composite", "src9_upsert_edges", "txt1_mentions", "win4_interval_trend", "aud1_verify_chain"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    tmp = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tmp).config("spark.local.dir", tmp).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["win5_min_max"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is no query's time
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
