"""Wall seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query is written out in full (format noop) once, after one warm-up query that loads Spark's classes.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from tidemark import plans
from tidemark.session import session, ship

HEADLINE = (
    "candle_resample_4h",
    "l1_structure",
    "forward_outcomes",
    "atr_percentile",
    "ml_features",
    "similarity_engine",
    "similarity_batch",
    "topk_similarity",
    "forecast_flagship",
    "sentiment_vector",
    "macro_vector",
    "regime_v2",
    "evaluation_metrics",
    "drift_check",
    "topology_vector",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as shared:
        spark = session("bench", cores=cpus, **{"spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": shared})
        ship(spark)
        plans.QUERIES["serving_latest"](spark, sf).write.format("noop").mode("overwrite").save()
        took = {}
        for name in HEADLINE:
            began = time.perf_counter()
            plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
        spark.stop()
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
