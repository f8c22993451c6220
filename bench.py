"""Times every registered query and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Each
query runs to a sink that discards rows, after one untimed warm-up of the session;
the faster of BENCH_RUNS runs counts. ``direct`` times the textbook form of three
operators (self-joins, range join) over the same rows, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tideline import build_session  # noqa: E402
from tideline.plans.queries import QUERIES  # noqa: E402

# Textbook forms, in Spark SQL.
DIRECT = {
    "acquisition_funnel": """
        WITH days AS (SELECT DISTINCT o_custkey AS c, to_date(o_orderdate) AS d FROM orders),
        firsts AS (SELECT c, min(d) AS f FROM days GROUP BY c),
        flags AS (
          SELECT firsts.c,
                 max(IF(d > f AND datediff(d, f) <= 30, 1, 0)) AS a,
                 max(IF(datediff(d, f) > 30 AND d <= add_months(f, 3), 1, 0)) AS r
          FROM firsts JOIN days ON days.c = firsts.c GROUP BY firsts.c)
        SELECT count(*), sum(a), sum(a * r) FROM flags""",
    "cohort_matrix": """
        WITH months AS (SELECT DISTINCT o_custkey AS c, trunc(o_orderdate, 'month') AS m FROM orders),
        firsts AS (SELECT o_custkey AS c, trunc(min(o_orderdate), 'month') AS f FROM orders GROUP BY 1),
        sizes AS (SELECT f, count(DISTINCT c) AS n FROM firsts GROUP BY f),
        cells AS (
          SELECT f, m, count(DISTINCT months.c) AS active
          FROM firsts JOIN months ON months.c = firsts.c GROUP BY f, m)
        SELECT cells.f, m, n, active FROM cells JOIN sizes ON sizes.f = cells.f ORDER BY 1, 2""",
    "rolling_active_users": """
        WITH days AS (SELECT DISTINCT cast(to_date(ts) AS timestamp_ntz) AS d FROM events)
        SELECT d, count(DISTINCT user_id)
        FROM days JOIN events ON ts <= d AND ts > d - INTERVAL 30 DAYS GROUP BY d ORDER BY d""",
}


def timed(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]",
        app="bench",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false",
        # Call sites of every column are for error messages and cost as much as planning.
        spark__python__sql__dataFrameDebugging__enabled="false",
        spark__sql__dataFrameQueryContext__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    def textbook(text: str):
        for name in ("orders", "events"):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    timed(lambda: QUERIES["acquisition_funnel"](spark, sf_dir))
    timed(lambda: QUERIES["ab_significance"](spark, sf_dir))

    seconds = {
        name: min(timed(lambda: query(spark, sf_dir)) for _ in range(runs))
        for name, query in QUERIES.items()
    }
    direct = {
        name: min(timed(lambda: textbook(text)) for _ in range(runs)) for name, text in DIRECT.items()
    }
    report = {
        "metric": "total seconds of all registered queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "direct": {name: round(value, 3) for name, value in direct.items()},
    }
    spark.stop()
    print(json.dumps(report))


if __name__ == "__main__":
    main()
