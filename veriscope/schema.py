"""Schemas of the tables that the operators work on."""

from pyspark.sql import types as T

_S, _B, _D, _I = T.StringType(), T.BooleanType(), T.DoubleType(), T.IntegerType()

REPORTS = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("id", T.LongType()), ("text", _S), ("risk_level", _S), ("language", _S), ("county", _S), ("timestamp", T.TimestampType()), ("sender_hash", _S),
        ("hour_of_day", _I), ("day_of_week", _S), ("is_weekend", _B), ("text_length", _I), ("word_count", _I), ("has_urls", _B), ("has_mentions", _B),
        ("detection_method", _S), ("confidence_score", _D), ("region", _S), ("is_urban", _B), ("scores", T.MapType(_S, _D)), ("matched_keyword", _S),
        ("context_flag", _B), ("source_type", _S), ("source_url", _S), ("content_hash", _S), ("created_by", _S), ("ingestion_job_id", _S), ("explanation", _S), ("status", _S),
    ]]
)
AUDIT = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(n, _S) for n in ("job_id", "action", "source_type", "url", "reason", "risk_level")])
LEXICON = T.StructType([T.StructField("priority", _I), T.StructField("term", _S), T.StructField("risk_level", _S), T.StructField("context", _S)])

#: Risk levels in the order of reports (fixed values).
RISK_DOMAIN = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
