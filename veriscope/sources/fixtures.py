"""Reports, lexicon and candidates as views of the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.functions import text as X

#: (priority, term, risk level): terms that occur in the test corpus; the last is hidden by the second.
LEXICON_ROWS = [(1, "erblest", "HIGH"), (2, "ththre", "HIGH"), (3, "therou", "HIGH"), (4, "unga", "MEDIUM"), (5, "queau", "MEDIUM"), (6, "free", "MEDIUM"), (7, "ththre in", "HIGH")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(LEXICON_ROWS, "priority int, term string, risk_level string")
    return rows.withColumn("context", F.when(F.col("priority") <= 2, F.concat(F.lit("Term "), "term", F.lit(" is on the watch list."))))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension (county, region, is_urban): a row for each nation."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("county"), F.col("r_name").alias("region"), (F.col("n_nationkey") % 3 == 0).alias("is_urban"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report for each event; documents give the texts, nations the counties (user_id modulo 26: 25 has none)."""
    e = table(spark, sf_dir, "events")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("d_text"), F.col("lang").alias("d_lang"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name"))
    j = e.join(d, F.col("event_id") == F.col("doc_id"), "left").join(n, F.col("user_id") % 26 == F.col("n_nationkey"), "left")
    k, kind = F.col("event_id"), F.col("event_type")
    toxicity = F.when(kind != "signup", F.least(F.lit(1.0), F.col("value") / 100))
    keyword = F.when(k % 10 == 0, F.concat(F.lit("kw"), (F.col("user_id") % 12).cast("string")))
    flag = kind == "error"
    text = F.concat(F.coalesce("d_text", F.lit("")), F.when(k % 5 == 0, " https://ex.org/a").otherwise(""), F.when(k % 4 == 0, F.concat(F.lit(" @u"), F.col("user_id").cast("string"), F.lit(" #tag"))).otherwise(""))
    risk = (
        F.when(k % 97 == 0, "UNKNOWN").when(keyword.isNotNull() & (k % 20 == 0), "HIGH").when(flag, "HIGH").when(toxicity > 0.7, "HIGH").when(toxicity >= 0.4, "MEDIUM")
        .when(toxicity.isNull() & keyword.isNull(), "MEDIUM").otherwise("LOW")
    )
    status = F.when(kind == "click", "Reviewed").when(kind == "purchase", "escalated").when(kind == "view", "pending")
    base = j.select(
        k.alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), text.alias("text"), F.coalesce("d_lang", F.lit("unknown")).alias("language"), F.coalesce("n_name", F.lit("unknown")).alias("county"),
        F.when(toxicity.isNotNull(), F.create_map(F.lit("toxicity"), toxicity)).alias("scores"), keyword.alias("matched_keyword"), flag.alias("context_flag"), status.alias("status"), risk.alias("risk_level"),
        X.sender_hash(F.col("user_id").cast("string")).alias("sender_hash"), F.when(k % 3 == 0, "system").otherwise("api").alias("created_by"),
    )
    return E.detection_fields(E.content_fields(E.temporal_fields(E.geo_enrich(base, places(spark, sf_dir)))))


def feed_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://news.example.org/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("?utm_source=x#top"))
    return d.select(F.col("doc_id").alias("key"), url.alias("url"), F.col("lang").alias("title"), F.col("text").alias("snippet"), F.lit("rss").alias("source_type"), F.lit("https://news.example.org/feed").alias("source_feed"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports: the candidates with an even key."""
    from veriscope.operators.ingest import prepare

    return prepare(feed_side(spark, sf_dir).where("key % 2 = 0")).select("source_url", "content_hash")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream, with timestamp, risk level by value and kind, and a content hash."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    score = F.col("value") / 100
    risk = F.when(F.col("event_type") == "error", "HIGH").when(score > 0.7, "HIGH").when(score >= 0.4, "MEDIUM").otherwise("LOW")
    hashed = X.content_hash(F.concat("event_type", F.lit(" "), (F.col("user_id") % 50).cast("string")))
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), risk.alias("risk_level"), hashed.alias("content_hash"))
