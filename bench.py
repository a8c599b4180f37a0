"""Time the registered queries and print one line of JSON.

The folder comes from BENCH_SF_DIR, the number of cores from BENCH_CPUS. Raw
lines and the saved enriched tables are prepared first and timed as "prepare".
Every query then runs to the end once; its rows go nowhere.

    python bench.py [query ...]
"""

import json
import os
import sys
import time

from checks.compare import session
from checks.queries import QUERIES
from checks.views import Views

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def main() -> None:
    spark = session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    views = Views(spark, FOLDER)
    times = {}

    start = time.time()
    views.station_file(), views.flight_file(), views.hourly(), views.daily(), views.planted()
    times["prepare"] = round(time.time() - start, 3)

    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    result = {
        "metric": "total time of all registered queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "cpus": int(CPUS),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
