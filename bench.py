"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from skyquill.plans import catalogue
from skyquill.sources.table import Table

HEADLINE = ["search_term", "search_phrase", "search_prefix", "search_fuzzy1", "search_mixed_sql", "search_group_by", "hist_price", "hist_sum", "date_hist_1h", "range_bucket_sum", "agg_simple", "agg_group", "join_star", "join_asof", "win_rank", "topk", "data_skipping", "count_metadata"]


def main() -> None:
    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, out = dict(catalogue.queries()), {}
    # queries on a versioned table: the table is written before the clock starts
    orders = Table(spark, f"file://{tempfile.mkdtemp(prefix='skyquill-')}/orders")
    orders.write(spark.read.parquet(f"{data}/orders.parquet").repartitionByRange(8, "o_orderkey"))
    found["count_metadata"] = lambda *_: Table(spark, orders.path).count()
    found["data_skipping"] = lambda *_: Table(spark, orders.path).read([("o_orderkey", ">=", 100), ("o_orderkey", "<=", 200)])
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.time()
            found[name](spark, data).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        out[name] = round(sorted(times)[1], 3)
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": data.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
