"""Time the registered queries; prints one JSON line.

``queries`` holds the second run of each query in this session, its first run is
in ``cold``. Every query starts from the given tables; the dimensions with ids,
which grow with the names, are stored by the first that needs them. ``value`` is
the sum of the second runs. Every query writes its whole result to Spark's no-op
sink.

    BENCH_SF_DIR  folder of source tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads             (default 8)
    BENCH_ONLY    comma-separated queries   (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywright.plans.registry import all_queries  # noqa: E402
from tallywright.session import build_session  # noqa: E402


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = build_session(
        "tallywright-bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: q for n, q in all_queries().items() if not only or n in only}

    def run(name):
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # starts the engine
    cold = {n: timed(lambda n=n: run(n)) for n in queries}
    warm = {n: timed(lambda n=n: run(n)) for n in queries}
    print(json.dumps({
        "metric": "all report, ingest and catalog queries",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
