"""Times the named queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the cores (default 8),
BENCH_RUNS the timed runs after a first one (default 1). `queries` holds the median
seconds of the timed runs, from building the plan to the last row; `first` those of the
first run; `load_sales` is the one-time join and store of the sales table that most
queries scan.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from hearthline import session
from hearthline.plans import registry, tables
from hearthline.runtime import finish


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    load = seconds(lambda: tables.sales_table(spark, sf_dir))
    first, timed = {}, {}
    for name in names or registry.QUERIES:
        run = lambda q=registry.QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save()
        first[name] = seconds(run)
        timed[name] = round(statistics.median(seconds(run) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "seconds over all queries, after a first run",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "first": first,
                "load_sales": load,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
                "runs": runs,
                "spark": spark.version,
            }
        )
    )
    finish(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
