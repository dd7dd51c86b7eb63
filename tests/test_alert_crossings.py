"""Alerts on crossing: against an ordered replay, and over a restart."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from veriscope.streaming import alerts

T0 = datetime(2024, 3, 1)
HOUR = timedelta(hours=1)


def replay(events, hours, threshold):
    """Alerts by key from all events in order of time, moment by moment."""
    out = []
    for key in {k for k, _ in events}:
        times = sorted(t for k, t in events if k == key)
        armed = True
        for now in sorted({*times, *(t + hours * HOUR for t in times)}):
            n = sum(now - hours * HOUR < t <= now for t in times)
            if n < threshold:
                armed = True
            elif armed:
                out.append((key, now, n))
                armed = False
    return sorted(out)


@pytest.fixture()
def state_store(spark):
    old = spark.conf.get(alerts.STATE_STORE[0])
    spark.conf.set(*alerts.STATE_STORE)
    yield spark
    spark.conf.set(alerts.STATE_STORE[0], old)


def run(spark, at, hours, threshold):
    stream = spark.readStream.schema("timestamp timestamp, risk_level string, county string").option("maxFilesPerTrigger", 1).json(str(at / "in"))
    q = alerts.alert_crossings(stream, "county", hours, threshold, late="30 minutes").writeStream.outputMode("append").option("checkpointLocation", str(at / "check"))
    q.trigger(availableNow=True).start(str(at / "out"), format="parquet").awaitTermination()
    return sorted((r["key"], r["fired_at"], r["n"]) for r in spark.read.parquet(str(at / "out")).collect())


def land(spark, at, events):
    rows = [(t.isoformat(), "HIGH", k) for k, t in events] + [(t.isoformat(), "LOW", k) for k, t in events]
    spark.createDataFrame(rows, "timestamp string, risk_level string, county string").coalesce(1).write.mode("append").json(str(at / "in"))


def test_crossings_over_a_restart(state_store, tmp_path):
    spark, rng = state_store, random.Random(3)
    events = [(rng.choice("ab"), T0 + timedelta(minutes=rng.randrange(0, 60 * 20))) for _ in range(60)]
    events += [("a", T0 + timedelta(hours=40, minutes=m)) for m in range(5)]
    end = [("end", T0 + timedelta(days=9))]
    want = replay(events, 3, 5)
    assert len(want) > 3
    events.sort(key=lambda e: e[1])
    shuffled = [e for i in range(0, len(events), 3) for e in reversed(events[i : i + 3])]  # out of order, not too late
    cut = len(shuffled) // 2
    land(spark, tmp_path, shuffled[:cut])
    first = run(spark, tmp_path, 3, 5)
    assert run(spark, tmp_path, 3, 5) == first  # a restart without news fires nothing again
    land(spark, tmp_path, shuffled[cut:])
    run(spark, tmp_path, 3, 5)
    land(spark, tmp_path, end)
    got = run(spark, tmp_path, 3, 5)
    land(spark, tmp_path, [("end", T0 + timedelta(days=20))])
    got = run(spark, tmp_path, 3, 5)
    assert got == want


def test_crossing_rule():
    times, counts = np.array([0, 10]), np.array([3, 2])
    assert alerts.crossings(times, counts, -1, 10, 100, 5, True) == ([(10, 5)], False)
    assert alerts.crossings(times, counts, 10, 100, 100, 5, False) == ([], True)
    assert alerts.crossings(times, counts, 100, 500, 100, 1, True) == ([], True)
    with pytest.raises(ValueError):
        alerts.alert_crossings(None, threshold=0)
