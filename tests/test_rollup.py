"""The dashboard bundle as a view kept up by day."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veriscope.operators import analytics as A
from veriscope.operators.rollup import DayView, bundle_of, day_partials
from veriscope.sources import fixtures, sinks

COLUMNS = ["id", "timestamp", "county", "risk_level", "matched_keyword", "hour_of_day", "day_of_week", "scores"]


def plain(df):
    return sorted(map(str, df.select("section", "key", "metric", "value").collect()))


def files(path):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_view_follows_late_rows(spark, small, tmp_path):
    r = fixtures.reports(spark, small).select(*COLUMNS).persist()
    late = r.where("timestamp >= '2024-01-10' and timestamp < '2024-01-11' and risk_level = 'HIGH'")
    at, view = str(tmp_path / "reports"), DayView(spark, str(tmp_path / "reports"), str(tmp_path / "view"))
    sinks.save_reports(r.join(late.select("id"), "id", "left_anti"), at)
    assert len(view.refresh()) == r.select(F.to_date("timestamp")).distinct().count() and view.refresh() == []
    before = files(tmp_path / "view")
    sinks.save_reports(late, at)
    assert [str(d) for d in view.refresh()] == ["2024-01-10"]
    after = files(tmp_path / "view")
    assert len(before.items() & after.items()) == len(before) - 1  # the other days' files are as they were
    assert plain(view.bundle()) == plain(A.bundle(r))
    start, end = datetime(2024, 1, 5, 7, 30), datetime(2024, 1, 20, 12)
    for a, b in ((start, end), (start, None), (None, end), (start, start + timedelta(hours=3)), (datetime(2023, 1, 1), datetime(2023, 2, 1))):
        got = view.bundle(a, b, datetime(2024, 2, 1))
        assert plain(got) == plain(A.bundle(A.in_range(r, a, b)))
        assert {(x["range_start"], x["range_end"], x["generated_at"]) for x in got.collect()} == {(a, b, datetime(2024, 2, 1))}
    r.unpersist()


def test_day_that_goes(spark, six_days, tmp_path):
    at, view = str(tmp_path / "reports"), DayView(spark, str(tmp_path / "reports"), str(tmp_path / "view"))
    sinks.save_reports(six_days, at)
    view.refresh()
    gone = six_days.where("id = 0").select(F.to_date("timestamp").cast("string")).first()[0]
    os.rename(f"{at}/date={gone}", tmp_path / "away")
    view.refresh()
    assert plain(view.bundle()) == plain(A.bundle(six_days.where(F.to_date("timestamp").cast("string") != gone)))


def test_one_scan_and_nulls(spark, six_days, tmp_path):
    six_days.write.parquet(str(tmp_path / "r"))
    d = spark.read.parquet(str(tmp_path / "r"))
    plan = A.bundle(d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Cartesian" not in plan and "NestedLoop" not in plan
    odd = six_days.withColumns({"county": F.lit(None).cast("string"), "risk_level": F.lit(None).cast("string"), "scores": F.lit(None).cast("map<string,double>"), "timestamp": F.lit(None).cast("timestamp")})
    got = {(x["section"], x["key"], x["metric"]): x["value"] for x in bundle_of(day_partials(odd)).collect()}
    assert got["risk_distribution", "UNKNOWN", "n"] == 6 and got["county", None, "total"] == 6 and got["summary", "all", "avg_toxicity"] == 0.0 and got["risk_distribution", "HIGH", "n"] == 0
    none = {(x["section"], x["key"]): x["value"] for x in A.bundle(d.limit(0)).collect()}
    assert none == {("summary", "all"): 0.0, **{("risk_distribution", k): 0.0 for k in ("HIGH", "MEDIUM", "LOW", "UNKNOWN")}}
