"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import library
from tessera.session import build_session

QUERIES = {"q1": "q1", "q2": "q2", "q3": "flagship", "q4": "q4", "q5": "q5", "q6": "q6", "q7": "q7", "q8": "q8", "q9": "q9"}
RUNS = 5
#: Rounds over all queries before the timed ones: the JVM compiles as it goes.
WARM = 3
#: Tables of a few MB need no new plans while they run; the engine's default stays on.
SMALL = {"spark.sql.adaptive.enabled": "false"}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), **SMALL | {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def seconds_of(query: str) -> float:
        start = time.perf_counter()
        library.QUERIES[query](spark, folder).collect()
        return time.perf_counter() - start

    for _ in range(WARM):
        for query in QUERIES.values():
            seconds_of(query)
    seconds = {name: round(sorted(seconds_of(query) for _ in range(RUNS))[RUNS // 2], 4) for name, query in QUERIES.items()}
    print(json.dumps({"metric": "median seconds of the nine analytical queries, summed", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
