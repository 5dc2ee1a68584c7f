"""Times of the headline queries on one machine, as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from gridspan import col
from gridspan import queries as q

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Queries that only read: their tables are written before the clock starts.
READS = ("agg_grouped", "vector_cosine_query", "vector_slice_nd", "vector_reduce", "scalar_and_pairwise", "join_tables", "top_k_rows")
#: Queries whose writes are what is timed, the creation of their table included.
CHANGES = ("update_expression", "update_stacked", "delete_then_compact")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run, repeat: int = 3) -> None:
        found = []
        for _ in range(repeat):
            start = time.perf_counter()
            run()
            found.append(time.perf_counter() - start)
        times[name] = round(sorted(found)[len(found) // 2], 4)

    events = q._events(spark, SF)
    most = events.table.scan().count()
    pruned = {
        "q1_point": [col("event_id") == most // 2],
        "q2_hash": [col("event_type") == "click"],
        "q3_point_and_hash": [col("event_id") == most // 2, col("event_type") == "click"],
        "q4_full": [],
        "q5_range_and_hash": [col("event_id").between(1, most // 16), col("event_type") == "click"],
        "q6_wide_range_and_hash": [col("event_id").between(1, most // 2), col("event_type") == "click"],
        "q7_small_range_and_hash": [col("event_id").between(1, most // 100), col("event_type") == "click"],
    }
    for name, filters in pruned.items():
        frame = events
        for f in filters:
            frame = frame.filter(f)
        timed(name, frame.count)
    for name in READS:
        df = q.QUERIES[name](spark, SF)
        timed(name, lambda df=df: df.write.format("noop").mode("overwrite").save())
    for name in CHANGES:
        timed(name, lambda f=q.QUERIES[name]: f(spark, SF).write.format("noop").mode("overwrite").save(), 2)
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF)}))


if __name__ == "__main__":
    main()
