"""Live sessions over all channels against the rule itself, over several batches."""

import random
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from pulseloom.streaming.sessions import end_of_stream, global_sessions, start_global_sessions

GAP = 5


def plain(rows):
    out = []
    for t, charge in sorted(rows, key=lambda r: r[0]):
        if out and t - out[-1][3] <= GAP * 1_000_000:
            out[-1] = (out[-1][0] + 1, out[-1][1] + charge, out[-1][2], t)
        else:
            out.append((1, charge, t, t))
    return sorted(out)


def test_sessions_over_many_batches(spark):
    rng = random.Random(3)
    rows, t = [], 1_700_000_000_000_000
    for _ in range(600):
        # steps below, at and above the gap, and long sessions that span many slots and batches
        t += rng.choice([0, 1, 400_000, 4_999_999, 5_000_000] * 3 + [5_000_001, 60_000_000])
        rows.append((t, rng.randrange(100)))
    folder = Path(tempfile.mkdtemp(prefix="run-"))
    frame = lambda part: spark.createDataFrame(part, "us long, charge long").select(F.timestamp_micros("us").alias("ts"), "charge")
    for i in range(0, 600, 100):
        part = rows[i : i + 100]
        rng.shuffle(part)
        frame(part).coalesce(1).write.parquet(f"{folder}/in/{i}")
    end_of_stream(frame(rows), "ts", f"{GAP} seconds", [], late="30 seconds").coalesce(1).write.parquet(f"{folder}/in/{600}")
    schema = frame(rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    for _ in range(2):  # a second start finds nothing new and changes nothing
        query = start_global_sessions(stream, "ts", GAP, f"{folder}/out", late="30 seconds")
        query.awaitTermination()
        got = global_sessions(spark, f"{folder}/out", with_open=True).select("n_pulses", "charge", "t_first", "t_last").collect()
        assert sorted(tuple(r) for r in got) == plain(rows)
    assert global_sessions(spark, f"{folder}/out").count() == len(plain(rows)) - 1
