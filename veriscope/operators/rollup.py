"""The dashboard bundle from partial aggregates: one pass over reports, and a stored view that is kept up day by day.

``day_partials`` groups reports by day and, in one expand, by each key that the bundle asks for. Partials of days add up,
so a bundle over any range is a sum of them. ``DayView`` stores them by day together with a fingerprint of the day's
files; a refresh lists files, compares fingerprints and computes again only the days that are new or have changed. A
range that begins or ends inside a day takes that day's rows from the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.schema import RISK_DOMAIN

#: The bundle's keys: set of groups -> column of reports. The set "all" has no key.
KEYS = {"county": "county", "risk": "risk_level", "keyword": "matched_keyword", "hour": "hour_of_day", "weekday": "day_of_week"}
COUNTS = ["high", "medium", "low", "total"]
SUMS = [*COUNTS, "score_sum", "score_n"]
TOP_KEYWORDS = 10


def day_partials(reports: DataFrame) -> DataFrame:
    """day, set, key, high, medium, low, total, score_sum, score_n: reports by day for each set of groups."""
    risk = F.coalesce("risk_level", F.lit("UNKNOWN"))
    base = reports.select(
        F.to_date("timestamp").alias("day"), *[(risk if s == "risk" else F.col(c).cast("string")).alias(s) for s, c in KEYS.items()], risk.alias("_risk"), E.max_score(F.col("scores")).alias("_score"),
    )
    sets = [["day"], *(["day", s] for s in KEYS)]
    counts = [F.count_if(F.col("_risk") == x).alias(x.lower()) for x in RISK_DOMAIN[:3]]
    got = base.groupingSets(sets, "day", *KEYS).agg(F.grouping_id().alias("_id"), *counts, F.count("*").alias("total"), F.coalesce(F.sum("_score"), F.lit(0.0)).alias("score_sum"), F.count("_score").alias("score_n"))
    # the bits of the grouping id are the columns that a set leaves out, the first in the highest
    ids = {s: (1 << len(KEYS)) - 1 - (1 << (len(KEYS) - 1 - i)) for i, s in enumerate(KEYS)}
    name, key = F.lit("all"), F.lit("all")
    for s, i in ids.items():
        name, key = F.when(F.col("_id") == i, s).otherwise(name), F.when(F.col("_id") == i, F.col(s)).otherwise(key)
    return got.select("day", name.alias("set"), key.alias("key"), *SUMS)


def bundle_of(partials: DataFrame) -> DataFrame:
    """section, key, metric, value of the bundle over the days of the partials. Reads them once."""
    spark = partials.sparkSession
    zero = spark.createDataFrame([(None, s, k) for s, k in [("all", "all"), *(("risk", x) for x in RISK_DOMAIN)]], "day date, set string, key string").withColumns({c: F.lit(0.0 if c == "score_sum" else 0).cast("double" if c == "score_sum" else "long") for c in SUMS})
    both = F.when(F.col("set") == "all", F.array(F.struct(F.lit("all").alias("set"), F.lit("all").alias("key")), F.struct(F.lit("date").alias("set"), F.date_format("day", "yyyy-MM-dd").alias("key")))).otherwise(F.array(F.struct("set", "key")))
    rows = partials.unionByName(zero).withColumn("_to", F.explode(both)).select("_to.*", *SUMS)
    sums = rows.groupBy("set", "key").agg(*[F.sum(c).alias(c) for c in SUMS])
    entry = lambda section, metric, value: F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))
    mean = F.round(F.col("score_sum") / F.when(F.col("score_n") > 0, F.col("score_n")), 3)
    four = lambda section: F.array(*[entry(section, c, F.col(c)) for c in COUNTS])
    s, filled = F.col("set"), (F.col("total") > 0) & (F.coalesce("key", F.lit("")) != "")
    out = (
        F.when(s == "all", F.array(entry("summary", "total", F.col("total")), entry("summary", "avg_toxicity", F.coalesce(mean, F.lit(0.0)))))
        .when(s == "risk", F.array(entry("risk_distribution", "n", F.col("total"))))
        .when((s == "county") & (F.col("total") > 0), four("county"))
        .when((s == "keyword") & filled, F.array(entry("keywords", "n", F.col("total"))))
        .when((s == "date") & (F.col("score_n") > 0), F.array(entry("toxicity", "avg_toxicity", mean), entry("toxicity", "n", F.col("score_n"))))
        .when((s == "hour") & filled, four("hourly")).when((s == "weekday") & filled, four("daily"))
    )
    long = sums.select("key", "total", "set", F.explode(out).alias("x")).select("x.section", "key", "x.metric", "x.value", "total")
    # the keywords alone are ranked: as many rows as the lexicon has terms that were met
    rank = F.when(F.col("section") == "keywords", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("total"), "key", "metric"))).otherwise(0)
    return long.withColumn("_rank", rank).where(F.col("_rank") <= TOP_KEYWORDS).select("section", "key", "metric", "value")


def stamped(bundle: DataFrame, start, end, as_of) -> DataFrame:
    """The bundle with its range (null: open) and the time of its making."""
    ts = lambda v: F.lit(v).cast("timestamp")
    return bundle.withColumns({"range_start": ts(start), "range_end": ts(end), "generated_at": ts(as_of)})


class DayView:
    """Partials at a path, by day, of reports stored by date (``sinks.save_reports``)."""

    def __init__(self, spark: SparkSession, reports: str, path: str):
        self.spark, self.reports, self.path = spark, reports, path

    def _files(self) -> DataFrame:
        """day, mark: one number for the day's files as they are, from their names, sizes and times; contents are not read."""
        f = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(self.reports)
        day = F.regexp_extract("path", r"/date=([^/]+)/", 1)
        return f.select(F.try_to_date(day).alias("day"), F.xxhash64("path", "length", "modificationTime").alias("h")).groupBy("day").agg(F.expr("bit_xor(h)").alias("mark"))

    def partials(self) -> DataFrame | None:
        """The stored partials; None before the first refresh."""
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return None
        p = self.spark.read.parquet(self.path)
        return p.withColumn("day", F.try_to_date(F.col("at").cast("string")))

    def refresh(self) -> list:
        """Computes the days again whose files are not those that the stored partials come from; returns these days."""
        now, before = self._files(), self.partials()
        if before is None:
            changed = now
        else:
            known = before.groupBy(F.col("day").alias("_day")).agg(F.first("mark").alias("was"))
            changed = now.join(known, F.col("day").eqNullSafe(F.col("_day")), "full").where(~F.col("mark").eqNullSafe(F.col("was"))).select(F.coalesce("day", "_day").alias("day"), "mark")
        rows = changed.select("day", "mark").collect()  # one row a day
        if not rows:
            return []
        days = [r["day"] for r in rows]
        marks = self.spark.createDataFrame([tuple(r) for r in rows], "day date, mark long")
        base = self.spark.read.parquet(self.reports)
        dates = F.col("date").isin([d for d in days if d is not None]) | (F.lit(None in days) & F.col("date").isNull())
        got = day_partials(base.where(dates))
        # a day of which nothing is left gets an empty row, so that its old partials go
        empty = marks.select("day", F.lit("all").alias("set"), F.lit("all").alias("key"), *[F.lit(0).cast("double" if c == "score_sum" else "long").alias(c) for c in SUMS])
        of = marks.select(F.col("day").alias("_day"), "mark")  # one row a day
        marked = got.unionByName(empty).join(F.broadcast(of), F.col("day").eqNullSafe(F.col("_day"))).drop("_day")
        by_day = marked.withColumn("at", F.coalesce(F.col("day").cast("string"), F.lit("none"))).drop("day")
        by_day.repartition("at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("at").parquet(self.path)
        return days

    def bundle(self, start=None, end=None, as_of=None) -> DataFrame:
        """The bundle of a range (both ends included; none: open). Whole days come from the stored partials, at most two
        days that the range cuts from the reports."""
        ts = lambda v: F.lit(v).cast("timestamp")
        p, cut = self.partials(), []
        if start is not None:
            p, cut = p.where(F.col("day") > F.to_date(ts(start))), [F.col("date") == F.to_date(ts(start))]
        if end is not None:
            p = p.where(F.col("day") < F.to_date(ts(end)))
            cut.append(F.col("date") == F.to_date(ts(end)))
        p = p.select("day", "set", "key", *SUMS)
        if cut:
            own = self.spark.read.parquet(self.reports).where(cut[0] if len(cut) == 1 else cut[0] | cut[1])
            own = own.where((F.col("timestamp") >= ts(start)) if start is not None else F.lit(True)).where((F.col("timestamp") <= ts(end)) if end is not None else F.lit(True))
            p = p.unionByName(day_partials(own))
        return stamped(bundle_of(p), start, end, as_of)
