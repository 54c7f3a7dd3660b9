"""Times a row-wise pandas form of four steps next to the built one, on the same views; prints one JSON line.

The pandas forms loop over waves, times and events in Python workers or, for anchors, in one task, as scripts on top of
pandas do. They exist only for this comparison.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from pulseloom import fixtures as fx  # noqa: E402
from pulseloom.catalog.common import GAP_US  # noqa: E402
from pulseloom.catalog.hits import hits  # noqa: E402
from pulseloom.functions import waveform as wf  # noqa: E402
from pulseloom.operators.sessions import anchor_events  # noqa: E402
from pulseloom.plans.hits import build_tracks  # noqa: E402
from pulseloom.session import local_session, materialize  # noqa: E402


@F.pandas_udf(T.ArrayType(T.LongType()))
def row_baseline(waves: pd.Series) -> pd.Series:
    return pd.Series([np.rint(np.asarray(w) - np.mean(w[:10])).astype(int).tolist() for w in waves])


@F.pandas_udf(T.ArrayType(T.LongType()))
def row_pulse_starts(waves: pd.Series) -> pd.Series:
    found = []
    for w in waves:
        starts, pos = [], 0
        while (i := next((k for k in range(pos, len(w)) if w[k] >= 50), None)) is not None:
            j = next((k for k in range(i + 1, len(w)) if w[k] <= 10), None)
            starts.append(max(0, i - 10))
            pos = len(w) if j is None else min(len(w), j + 9)
        found.append(starts)
    return pd.Series(found)


def row_anchor(batches):
    anchor, event = None, 0
    for pdf in batches:
        ids = []
        for t in pdf["t_us"]:
            if anchor is None or t - anchor > GAP_US:
                anchor, event = t, event + 1
            ids.append(event)
        yield pdf.assign(event_id=ids)


def row_track(pdf: pd.DataFrame) -> pd.DataFrame:
    z, x, w = (pdf[c].to_numpy() for c in ("z", "x", "w"))
    c = np.average([z, x], axis=1, weights=w)
    d = np.array([z, x]) - c[:, None]
    _, vecs = np.linalg.eigh((w * d) @ d.T / w.sum())
    angle = float(np.arctan2(vecs[1, 1], vecs[0, 1]))
    return pd.DataFrame({"event_id": [pdf["event_id"].iloc[0]], "angle": [angle]})


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "compare")
    spark.sparkContext.setLogLevel("ERROR")
    # copies of the given rows, so that work and not start-up is timed
    copies = int(os.environ.get("COMPARE_COPIES", "100"))
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")
    waves = materialize(fx.waves(spark, sf_dir).select("w", copy).repartition(8))
    flat = materialize(waves.select(wf.subtract_first("w").alias("y")).repartition(8))
    pulses = fx.pulses(spark, sf_dir)
    points = hits(spark, sf_dir).select("event_id", "z", "x", "w", "charge", copy)
    points = materialize(points.withColumn("event_id", F.col("event_id") * 1000 + F.col("copy")))
    one_task = pulses.select("pulse_no", "t_us").orderBy("t_us").coalesce(1)
    pairs = {
        "baseline": (lambda: waves.select(wf.subtract_first("w").alias("y")), lambda: waves.select(row_baseline("w").alias("y"))),
        "find_pulses": (
            lambda: flat.select(wf.pulse_spans("y", rise=50, fall=10, pre=10, post=8, minlen=4).alias("s")),
            lambda: flat.select(row_pulse_starts("y").alias("s")),
        ),
        "anchor_events": (
            lambda: anchor_events(pulses, "t_us", GAP_US),
            lambda: one_task.mapInPandas(row_anchor, "pulse_no bigint, t_us bigint, event_id bigint"),
        ),
        "track_fit": (
            lambda: build_tracks(points),
            lambda: points.filter("w > 0").groupBy("event_id").applyInPandas(row_track, "event_id bigint, angle double"),
        ),
    }

    def seconds(make) -> float:
        took = []
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        return round(statistics.median(took[1:]), 3)

    out = {}
    for name, (ours, rowwise) in pairs.items():
        a, b = seconds(ours), seconds(rowwise)
        out[name] = {"built": a, "row_wise_pandas": b, "ratio": round(b / a, 2)}
    print(json.dumps({"metric": "built_vs_row_wise_pandas", "steps": out, "copies": copies, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
