"""Times the headline queries, the median of five warm runs each; prints one line of JSON. Shuffle and spill are those of one run."""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemerge.queries import QUERIES

HEADLINE = ("merge_full", "merge_delta", "write_ops_last_wins", "sync_report", "upgrade_full_dedup", "rekey_rebuild", "hub_project_left", "hub_absorb_manual", "unified_view", "refcounts")


def stage_totals(spark: SparkSession) -> tuple[int, int]:
    """(bytes shuffled, bytes spilled) of all stages so far, as Spark counts them."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    each = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in each), sum(s.memoryBytesSpilled() + s.diskBytesSpilled() for s in each)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.retainedStages": "100000",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call site is looked up for each column expression
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took, moved = {}, {}
    for name in HEADLINE:
        times = []
        for run in range(6):
            before = stage_totals(spark) if run == 5 else (0, 0)
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if run:  # the first one warms up
                times.append(time.perf_counter() - began)
        took[name] = round(median(times), 3)
        print(name, took[name], file=sys.stderr)
        moved[name] = [b - a for a, b in zip(before, stage_totals(spark), strict=True)]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "shuffle_bytes": {k: v[0] for k, v in moved.items()}, "spill_bytes": {k: v[1] for k, v in moved.items()}}))


if __name__ == "__main__":
    main()
