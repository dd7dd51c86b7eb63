"""Structured Streaming twins: alerts, ingestion, live counters, deduplication."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.operators import ingest
from veriscope.sources.commits import CommitLog
from veriscope.sources.keystore import KeyStore
from veriscope.sources.scratch import landed, scratch_path


def alert_windows(stream: DataFrame, threshold: int = 10, window: str = "24 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """HIGH reports by sliding window where they reach the threshold."""
    w = stream.where("risk_level = 'HIGH'").withWatermark("timestamp", late).groupBy(F.window("timestamp", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") >= threshold).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def live_counters(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window).alias("w"), "risk_level").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "risk_level", "n")


def dedupe(stream: DataFrame, key: str = "content_hash", late: str = "1 hour") -> DataFrame:
    """The first row of each key among rows within the watermark."""
    return stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark([key])


#: Columns of the tables that ingestion commits.
STORED = "source_url string, content_hash string, text string, risk_level string, source_type string"


def start_ingest(stream: DataFrame, store: str, lexicon: DataFrame, checkpoint: str, keywords=(), job_id: str = "stream"):
    """Each batch of candidates is held against the store, decided, classified and written with its audit rows.

    Reports and audit rows of a batch are committed together (``CommitLog`` at store: tables reports and audit); their keys
    then join the store of keys beside them (``store``/keys), whose filters keep new keys away from the stored ones. A
    batch that runs again after a failure is written if it was not committed; if it was, only its keys are added again,
    which changes nothing. So nothing is stored or judged twice, and no batch reads the reports of others.
    """
    spark = stream.sparkSession
    log = CommitLog(spark, store)
    keys = KeyStore.open_or_create(spark, f"{store}/keys")

    def batch(rows: DataFrame, number: int) -> None:
        if not log.has(number):
            done = landed(ingest.run_cycle(rows, keys, lexicon, keywords), "ingested")
            as_of = datetime.now(timezone.utc).isoformat()
            log.write(number, {"reports": done.where("action = 'verified'").select(*[f.split()[0] for f in STORED.split(", ")]), "audit": ingest.audit(done, f"{job_id}-{number}", as_of)})
        keys.add(ingest.store_keys(log.read("reports", STORED, number)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there into a table in memory: for aggregates, whose rows are few."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_to_files(df: DataFrame) -> DataFrame:
    """Runs a stream over what is there into files in the shared folder, and reads them."""
    out, check = scratch_path(df.sparkSession, "stream"), scratch_path(df.sparkSession, "checkpoint")
    df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)
