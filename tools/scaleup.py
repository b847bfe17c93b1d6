"""How the time of one job grows with the number of tests it analyses: ``python tools/scaleup.py [sf] [n ...]``."""

from __future__ import annotations

import datetime as dt
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F

from liftfield.operators import causal, panel, synth
from liftfield.operators.assign import hash_assignment
from liftfield.session import build_session, cut_lineage
from parity import common


def main(sf: str, sizes: list[int]) -> None:
    folder = f"/root/testdata/{sf}"
    spark = build_session("scaleup", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    weekly = cut_lineage(common.weekly(spark, folder))
    markets = common.geos(spark, folder).select("geo")
    for n in [sizes[0], *sizes]:
        rows = [(f"t{i:04d}", dt.date(1997, 1, 6) + dt.timedelta(days=7 * (i % 180)), 182) for i in range(n)]
        tests = spark.createDataFrame(rows, "test_id string, start_date date, lookback_days int").withColumn(
            "end_date", F.date_add("start_date", 55))
        ids = F.array(*[F.lit(r[0]) for r in rows])
        cells = cut_lineage(hash_assignment(markets.select(F.explode(ids).alias("test_id"), "geo"), common.N_HOLDOUT))
        t0 = time.perf_counter()
        p = panel.test_panel(weekly, tests, cells)
        t1 = time.perf_counter()
        causal.difference_in_differences(p).write.format("noop").mode("overwrite").save()
        t2 = time.perf_counter()
        fitted = synth.ascm_series(synth.unit_series(p))
        t3 = time.perf_counter()
        synth.ascm_results(fitted).write.format("noop").mode("overwrite").save()
        t4 = time.perf_counter()
        print(f"{n:5d} tests: panel {t1 - t0:6.1f}s, did with 2000 replicates {t2 - t1:6.1f}s, "
              f"synthetic control of all targets {t3 - t2:6.1f}s, its inference {t4 - t3:6.1f}s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "sf0.1", [int(x) for x in sys.argv[2:]] or [1, 10, 100])
