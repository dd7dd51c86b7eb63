"""Sinks: reports, audit, last run, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.operators.analytics import EXPORTS, in_range, risk_distribution

SCORE_NAMES = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack")


def enrich_reports(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Reports as stored: time, content, detection and place columns derived, hash of the sender, status pending."""
    d = E.detection_fields(E.content_fields(E.temporal_fields(E.geo_enrich(df, dim))))
    return d.withColumn("status", F.coalesce("status", F.lit("pending")) if "status" in df.columns else F.lit("pending"))


def save_reports(df: DataFrame, path: str) -> None:
    df.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(path)


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_last_run(counts: DataFrame, job_id: str, as_of, path: str) -> None:
    counts.agg(F.map_from_entries(F.collect_list(F.struct("outcome", "n"))).alias("counts")).withColumns({"job_id": F.lit(job_id), "finished_at": F.lit(as_of).cast("timestamp")}).write.mode("overwrite").parquet(path)


def last_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten(df: DataFrame) -> DataFrame:
    """Reports in 29 flat columns for delimited files: no nulls, the time in three forms, the scores by name."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    t = F.col("timestamp")
    when = [F.coalesce(F.date_format(t, p), F.lit("")).alias(n) for n, p in (("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), ("date", "yyyy-MM-dd"), ("time", "HH:mm:ss"))]
    scores = [F.coalesce(F.element_at("scores", n), F.lit(0.0)).alias(n) for n in SCORE_NAMES]
    return df.select(
        empty("id"), *[empty(c) for c in ("text", "risk_level", "language", "county", "region")], no("is_urban"), *when, empty("hour_of_day"), empty("day_of_week"), no("is_weekend"),
        F.coalesce(F.col("text_length").cast("long"), F.lit(0)).alias("text_length"), F.coalesce(F.col("word_count").cast("long"), F.lit(0)).alias("word_count"), no("has_urls"), no("has_mentions"),
        empty("detection_method"), F.coalesce("confidence_score", F.lit(0.0)).alias("confidence_score"), empty("matched_keyword"), no("context_flag"), *scores, F.coalesce(E.max_score(F.col("scores")), F.lit(0.0)).alias("max_toxicity"), empty("sender_hash"),
    )


def select_fields(df: DataFrame, fields=None) -> DataFrame:
    """The wanted columns in the order asked for; unknown names are ignored."""
    return df if fields is None else df.select(*[f for f in fields if f in df.columns])


def export_csv(df: DataFrame, path: str, start=None, end=None, fields=None) -> None:
    """Reports, latest first: the parts of the range order are files, in the order that ``export_order`` gives."""
    select_fields(flatten(in_range(df, start, end).orderBy(F.desc("timestamp"), F.desc("id"))), fields).write.mode("overwrite").option("header", True).csv(path)


def export_order(spark: SparkSession, path: str) -> DataFrame:
    """place, file: the files of an export in the order of its rows. Spark numbers them by their part of the order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"))
    return files.select(F.regexp_extract("file", r"^part-(\d+)", 1).cast("int").alias("place"), "file").orderBy("place")


def as_json_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))


def export_json(df: DataFrame, path: str, flat: bool = False) -> None:
    (flatten(df) if flat else as_json_rows(df)).write.mode("overwrite").json(path)


def export_aggregate(df: DataFrame, name: str, path: str, start=None, end=None) -> None:
    if name not in EXPORTS:
        raise ValueError(f"unknown aggregate {name}; there are {sorted(EXPORTS)}")
    EXPORTS[name](in_range(df, start, end)).write.mode("overwrite").option("header", True).csv(path)


def export_pack(df: DataFrame, path: str, start=None, end=None) -> None:
    """Reports and summary of a range in one folder."""
    d = in_range(df, start, end)
    export_csv(d, f"{path}/reports")
    risk_distribution(d).write.mode("overwrite").json(f"{path}/summary")
