"""Throughput of the volume operators on a synthetic post-stack volume; prints one JSON line.

BENCH_VOLUME (default 160x240x462) gives lines, crosslines and samples; BENCH_CPUS (8) the threads; the volume
is written as tiled Parquet under BENCH_DIR (default /tmp/bench_volume) and read from there.
"""

from __future__ import annotations

import json
import os
import sys
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from borespark.operators import neighborhood, time_depth
from borespark.operators.traces import Step, run_pipeline
from borespark.session import get_session
from borespark.sources import segy
from borespark.sources.segy import read_volume, write_volume

INTERVAL = 4.0


def synthetic(spark, il: int, xl: int, n: int):
    def make(it):
        for pdf in it:
            t = np.arange(n) * INTERVAL / 1000
            for i, x in zip(pdf["il"], pdf["xl"], strict=True):
                r = np.random.default_rng(int(i) * 100_003 + int(x))
                trace = np.sin(2 * np.pi * 25 * (t - 0.001 * i)) * np.exp(-t) + 0.1 * r.normal(size=n)
                yield pd.DataFrame({"il": [i], "xl": [x], "amplitude": [trace.astype(np.float32)]})

    grid = spark.range(il * xl).select(F.floor(F.col("id") / xl).alias("il"), (F.col("id") % xl).alias("xl")).repartition(32)
    return grid.mapInPandas(make, "il long, xl long, amplitude array<float>")


def measure(spark, il: int, xl: int, n: int, folder: str) -> dict[str, dict[str, float]]:
    """Seconds and million samples a second of every operator over a volume that is made below the folder."""
    path, trace_file = f"{folder}/{il}x{xl}x{n}", f"{folder}/{il}x{xl}x{n}.sgy"
    if not os.path.exists(path + "/_SUCCESS"):
        write_volume(synthetic(spark, il, xl, n), path)
    volume = read_volume(spark, path)
    around = neighborhood.Around
    depths = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: k * (INTERVAL * 1.2 + F.col("xl") % 7 * 0.01))

    def noop(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def export() -> None:
        rows = volume.select((F.col("il") * xl + F.col("xl")).alias("trace"), F.col("il").alias("inline"), F.col("xl").alias("crossline"), "amplitude")
        segy.export_traces(rows, trace_file, segy.make_layout(il * xl, n, int(INTERVAL * 1000)), ["inline", "crossline"])

    runs = {
        "agc": lambda: noop(run_pipeline(volume, [Step("agc", {"window_ms": 500.0})], INTERVAL)),
        "analytic_5_steps": lambda: noop(run_pipeline(volume, [Step("rms_normalise"), Step("bandpass", {"f1": 5.0, "f2": 10.0, "f3": 60.0, "f4": 80.0}), Step("phase_rotation", {"degrees": 30.0}), Step("agc", {"window_ms": 500.0}), Step("envelope")], INTERVAL)),
        "similarity_24ms_1x1": lambda: noop(neighborhood.similarity(volume, INTERVAL, around(1, 1, 24.0))),
        "similarity_48ms_2x2": lambda: noop(neighborhood.similarity(volume, INTERVAL, around(2, 2, 48.0))),
        "similarity_96ms_4x4": lambda: noop(neighborhood.similarity(volume, INTERVAL, around(4, 4, 96.0))),
        "local_statistics_24ms_1x1": lambda: noop(neighborhood.local_statistics(volume, INTERVAL, around(1, 1, 24.0))),
        "dip_24ms_1x1": lambda: noop(neighborhood.dip(volume, INTERVAL, around(1, 1, 24.0))),
        "section_read": lambda: noop(read_volume(spark, path, il=(il // 2, il // 2))),
        "depth_conversion": lambda: noop(time_depth.to_depth(volume.withColumn("depths", depths), INTERVAL)),
        "segy_export": export,
        "segy_ingest": lambda: segy.ingest_volume(spark, trace_file, path + "-ingested"),
    }
    out = {}
    for name, run in runs.items():
        took = float("inf")
        for _ in range(2):  # the better of two runs, as the first compiles
            start = time.perf_counter()
            run()
            took = min(took, time.perf_counter() - start)
        size = (1 if name == "section_read" else il) * xl * n
        out[name] = {"sec": round(took, 3), "million_samples_per_sec": round(size / took / 1e6, 2)}
        print(name, out[name], file=sys.stderr)
    return out


def main() -> None:
    il, xl, n = (int(v) for v in os.environ.get("BENCH_VOLUME", "160x240x462").split("x"))
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_DIR", "/tmp/bench_volume")
    spark = get_session(f"local[{cpus}]", "bench-volume", **{"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "32", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"})
    spark.sparkContext.setLogLevel("ERROR")
    print(json.dumps({"volume": [il, xl, n], "cpus": int(cpus), "runs": measure(spark, il, xl, n, folder)}))


if __name__ == "__main__":
    main()
