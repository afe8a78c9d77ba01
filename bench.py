"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from ostinato.catalog import catalog
from ostinato.session import build_session

HEADLINE = (
    "cell_summary",
    "detrend_two_pass",
    "detrended_significant",
    "cosinor_fit",
    "cosinor_multiperiod",
    "damped_cosinor",
    "bh_global",
    "bh_grouped",
    "hommel",
    "dct_periods",
    "wavelet_summary",
    "jtk",
    "ejtk",
    "pearson_corr",
    "spearman_corr",
    "bicor_corr",
    "scale_free_table",
    "tom_edges",
    "modules",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    queries, seconds = catalog(), {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
