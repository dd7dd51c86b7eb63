"""The analytic questions over reports: each takes and returns a DataFrame, in one pass and without driver loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.functions import text as X
from veriscope.schema import RISK_DOMAIN


def in_range(df: DataFrame, start=None, end=None, ts: str = "timestamp", end_of_day: bool = False) -> DataFrame:
    """start <= timestamp <= end, either end optional; with end_of_day the whole last day counts."""
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        last = F.lit(end).cast("timestamp")
        df = df.where(F.col(ts) < F.date_trunc("day", last) + F.expr("interval 1 day")) if end_of_day else df.where(F.col(ts) <= last)
    return df


def _risk(df: DataFrame) -> Column:
    return F.coalesce("risk_level", F.lit("UNKNOWN"))


def risk_counts(df: DataFrame, *keys, percent: bool = False, unknown: bool = False) -> DataFrame:
    """Reports by key and risk level in columns, with their total (UNKNOWN counts in the total alone unless asked for)."""
    levels = RISK_DOMAIN if unknown else RISK_DOMAIN[:3]
    out = df.groupBy(*keys).agg(*[F.count_if(_risk(df) == x).alias(x.lower()) for x in levels], F.count("*").alias("total"))
    if percent:
        out = out.withColumns({f"{x.lower()}_percentage": F.round(F.col(x.lower()) / F.col("total") * 100, 6) for x in levels})
    return out


def risk_distribution(df: DataFrame) -> DataFrame:
    """Reports by risk level; the four levels are always there."""
    domain = df.sparkSession.createDataFrame([(x, 0) for x in RISK_DOMAIN], "risk_level string, n long")
    return df.select(_risk(df).alias("risk_level"), F.lit(1).cast("long").alias("n")).unionByName(domain).groupBy("risk_level").agg(F.sum("n").alias("n"))


def risk_share(df: DataFrame) -> DataFrame:
    got = risk_distribution(df).where("n > 0")
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("all")))).select("risk_level", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def county_risk(df: DataFrame, county: str | None = None) -> DataFrame:
    d = df if county is None else df.where(F.col("county") == county)
    return risk_counts(d, "county", percent=True)


def top(df: DataFrame, by: Column, limit: int, *ties) -> DataFrame:
    """The first rows by a figure, ties by the given columns."""
    return df.orderBy(by.desc(), *ties).limit(limit)


def keyword_trends(df: DataFrame, limit: int = 20) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be at least 1")
    return top(df.where(F.nullif("matched_keyword", F.lit("")).isNotNull()).groupBy("matched_keyword").agg(F.count("*").alias("n")), F.col("n"), limit, "matched_keyword")


def toxicity_trends(df: DataFrame, start=None, end=None, days: int = 30, as_of=None) -> DataFrame:
    """Mean of the reports' largest scores by day; without start and end, of the last days before as_of."""
    if not 1 <= days <= 365:
        raise ValueError("days must be 1 to 365")
    d = in_range(df, start, end)
    if start is None and end is None and as_of is not None:
        d = df.where(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))
    s = d.select(F.date_format("timestamp", "yyyy-MM-dd").alias("date"), E.max_score(F.col("scores")).alias("s")).where("s is not null")
    return s.groupBy("date").agg(F.round(F.avg("s"), 3).alias("avg_toxicity"), F.count("*").alias("n")).orderBy("date")


def hourly_patterns(df: DataFrame) -> DataFrame:
    return risk_counts(df.where("hour_of_day is not null"), "hour_of_day", percent=True)


def hourly_series(df: DataFrame) -> DataFrame:
    return risk_counts(df.where("hour_of_day is not null"), "hour_of_day").withColumn("label", F.concat(F.lpad(F.col("hour_of_day").cast("string"), 2, "0"), F.lit(":00"))).orderBy("hour_of_day")


def daily_patterns(df: DataFrame) -> DataFrame:
    return risk_counts(df.where("nullif(day_of_week, '') is not null"), "day_of_week", percent=True)


def peak_hours(df: DataFrame, limit: int = 5) -> DataFrame:
    return top(risk_counts(df.where("hour_of_day is not null"), "hour_of_day"), F.col("high"), limit, "hour_of_day").select("hour_of_day", "high")


def detection_comparison(df: DataFrame) -> DataFrame:
    """HIGH reports by what found them: both, lexicon alone, context check alone, neither."""
    keyword, flag = F.coalesce("matched_keyword", F.lit("")) != "", F.coalesce("context_flag", F.lit(False))
    kinds = {"both": keyword & flag, "lexicon_only": keyword & ~flag, "context_only": ~keyword & flag, "neither": ~keyword & ~flag}
    out = df.where("risk_level = 'HIGH'").agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in kinds.items()])
    return out.withColumns({f"{k}_percentage": F.when(F.col("total") > 0, F.round(F.col(k) / F.col("total") * 100, 6)) for k in kinds})


def geo_heatmap(df: DataFrame) -> DataFrame:
    """By county: risk counts, mean of the largest scores, risk score (3 high + 2 medium + low) / total, share of high."""
    s = df.select("county", "risk_level", E.max_score(F.col("scores")).alias("s"))
    counts = [F.count_if(_risk(s) == x).alias(x.lower()) for x in RISK_DOMAIN[:3]]
    out = s.groupBy("county").agg(*counts, F.count("*").alias("total"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 3).alias("avg_toxicity"))
    return out.withColumns({"risk_score": F.round((3 * F.col("high") + 2 * F.col("medium") + F.col("low")) / F.col("total"), 2), "high_percentage": F.round(F.col("high") / F.col("total") * 100, 6)})


def known_county(df: DataFrame) -> DataFrame:
    return df.where(F.lower("county") != "unknown")


def top_counties_by_risk(df: DataFrame, limit: int = 15) -> DataFrame:
    return top(known_county(geo_heatmap(df)), F.col("risk_score"), limit, "county").select("county", "risk_score", "total")


def top_counties_by_high_pct(df: DataFrame, limit: int = 5) -> DataFrame:
    return top(county_risk(df), F.col("high_percentage"), limit, "county").select("county", "high_percentage")


def county_risk_band(df: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    return geo_heatmap(df).select("county", "risk_score", F.when(s < 1, "low").when(s < 2, "medium").otherwise("high").alias("band"))


def detection_risk_matrix(df: DataFrame) -> DataFrame:
    return risk_counts(df.withColumn("detection_method", F.coalesce("detection_method", F.lit("unknown"))), "detection_method", unknown=True)


def confidence_histogram(df: DataFrame, bucket: float = 0.1) -> DataFrame:
    """Reports by confidence in buckets; the last one takes what is above. Only buckets with reports."""
    if not 0.01 <= bucket <= 0.5:
        raise ValueError("bucket must be 0.01 to 0.5")
    b, n = F.lit(float(bucket)), int(1 / bucket)
    i = F.least(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence_score"))) / b), F.lit(n - 1))
    d = df.where("confidence_score is not null and not isnan(confidence_score)").groupBy(i.alias("i")).agg(F.count("*").alias("n"))
    return d.select(F.format_string("%.2f-%.2f", F.col("i") * b, (F.col("i") + 1) * b).alias("bucket"), "n").orderBy("bucket")


def summary_scalars(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.round(F.coalesce(F.avg(E.max_score(F.col("scores"))), F.lit(0.0)), 3).alias("avg_toxicity"))


def summary_top_keywords(df: DataFrame) -> DataFrame:
    return keyword_trends(df, 5)


def summary_top_counties(df: DataFrame) -> DataFrame:
    return top(df.where("county <> 'unknown'").groupBy("county").agg(F.count("*").alias("n")), F.col("n"), 5, "county")


def anomalies(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Days whose number of reports is more than threshold population deviations off the mean day."""
    by = df.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("n"))
    one = by.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))  # one row
    off = F.abs(F.col("n") - F.col("mean"))
    hit = by.crossJoin(F.broadcast(one)).where((F.col("std") > 0) & (off > threshold * F.col("std")))
    return hit.select("date", "n", F.round("mean", 1).alias("expected"), F.round(off / F.col("std"), 2).alias("deviation")).orderBy(F.desc("deviation"), "date")


def top_tokens(df: DataFrame, limit: int = 20, levels=("HIGH",), min_length: int = 4) -> DataFrame:
    d = df.where(F.col("risk_level").isin(*levels)).select(F.explode(X.tokens(F.col("text"), min_length)).alias("token"))
    return top(d.groupBy("token").agg(F.count("*").alias("n")), F.col("n"), limit, "token")


def parse_levels(text: str | None) -> list[str]:
    got = [x.strip().upper() for x in (text or "").split(",") if x.strip()]
    return got or ["HIGH"]


def url_mention_risk(df: DataFrame) -> DataFrame:
    """Every report in one url group and one mention group, by risk level; the four groups are always there."""
    groups = ("with_urls", "without_urls", "with_mentions", "without_mentions")
    own = F.array(F.when(F.coalesce("has_urls", F.lit(False)), groups[0]).otherwise(groups[1]), F.when(F.coalesce("has_mentions", F.lit(False)), groups[2]).otherwise(groups[3]))
    got = risk_counts(df.select("risk_level", F.explode(own).alias("cohort")), "cohort", unknown=True)
    zero = df.sparkSession.createDataFrame([(g,) for g in groups], "cohort string")
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in got.columns[1:]]
    return got.unionByName(zero, allowMissingColumns=True).groupBy("cohort").agg(*sums)


def status_counts(df: DataFrame) -> DataFrame:
    """Reports by moderation status in lower case (none: pending), and their total."""
    s = F.lower(F.coalesce(F.nullif("status", F.lit("")), F.lit("pending")))
    return df.select(s.alias("status")).rollup("status").agg(F.count("*").alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def recent(df: DataFrame, limit: int = 10, status: str | None = None) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    d = df if status is None else df.where(F.col("status") == status)
    return d.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def report_by_id(df: DataFrame, report_id) -> DataFrame:
    return df.where(F.col("id") == report_id).limit(1)


def review_queue(df: DataFrame) -> DataFrame:
    return df.where("risk_level = 'HIGH' and created_by = 'system'")


def alert(df: DataFrame, as_of, window_hours: int = 24, threshold: int = 10, by=()) -> DataFrame:
    """HIGH reports of the hours before as_of where they reach the threshold (for each value of by)."""
    end = F.lit(as_of).cast("timestamp")
    d = df.where((F.col("timestamp") >= end - F.make_dt_interval(F.lit(0), F.lit(window_hours))) & (F.col("timestamp") <= end) & (F.col("risk_level") == "HIGH"))
    n = d.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    return n.select(*by, F.lit("high_risk_alert").alias("event"), F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("fired_at"), F.lit(window_hours).cast("long").alias("window_hours"), "n", F.lit(threshold).cast("long").alias("threshold"))


def bundle(df: DataFrame) -> DataFrame:
    """Seven analytics in one long table (section, key, metric, value), in one pass over the reports."""
    from veriscope.operators.rollup import bundle_of, day_partials

    return bundle_of(day_partials(df))


def over_time(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("date"), *keys).agg(F.count("*").alias("n"))


#: Aggregates that can be exported by name.
EXPORTS = {"risk_distribution": risk_distribution, "county_analysis": county_risk, "keyword_trends": lambda d: keyword_trends(d, 100), "toxicity_trends": toxicity_trends}
