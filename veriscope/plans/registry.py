"""All queries by name, and their SQL twins over the same tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.functions import text as X
from veriscope.operators import analytics as A
from veriscope.operators import classify as C
from veriscope.operators import ingest as I
from veriscope.operators import risk_model
from veriscope.operators.automaton import lexicon_match_large
from veriscope.operators.rollup import DayView
from veriscope.sources import fixtures, landed_feeds, readers, sinks
from veriscope.sources.commits import CommitLog
from veriscope.sources.keystore import KeyStore
from veriscope.sources.scratch import scratch_path
from veriscope.streaming import alerts, jobs

START, END, AS_OF = "2024-01-05 00:00:00", "2024-01-20 12:00:00", "2024-01-30 00:00:00"
KEYWORDS = ("the", "de")

#: Reports in SQL.
R = r"""
WITH e0 AS (
  SELECT *, CASE WHEN event_type = 'signup' THEN NULL ELSE least(1.0::DOUBLE, value / 100) END AS toxicity,
    CASE WHEN event_id % 10 = 0 THEN 'kw' || (user_id % 12) END AS matched_keyword, event_type = 'error' AS context_flag FROM events
), r0 AS (
  SELECT e.event_id AS id, e.ts AS timestamp,
    coalesce(d.text, '') || CASE WHEN e.event_id % 5 = 0 THEN ' https://ex.org/a' ELSE '' END || CASE WHEN e.event_id % 4 = 0 THEN ' @u' || e.user_id || ' #tag' ELSE '' END AS text,
    coalesce(d.lang, 'unknown') AS language, coalesce(n.n_name, 'unknown') AS county, coalesce(r.r_name, 'Unknown') AS region, coalesce(n.n_nationkey % 3 = 0, false) AS is_urban,
    toxicity, matched_keyword, context_flag,
    CASE event_type WHEN 'click' THEN 'Reviewed' WHEN 'purchase' THEN 'escalated' WHEN 'view' THEN 'pending' END AS status,
    CASE WHEN e.event_id % 97 = 0 THEN 'UNKNOWN' WHEN matched_keyword IS NOT NULL AND e.event_id % 20 = 0 THEN 'HIGH' WHEN context_flag THEN 'HIGH' WHEN toxicity > 0.7 THEN 'HIGH'
      WHEN toxicity >= 0.4 THEN 'MEDIUM' WHEN toxicity IS NULL AND matched_keyword IS NULL THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    CASE WHEN matched_keyword IS NOT NULL AND (context_flag OR toxicity IS NOT NULL) THEN 'combined' WHEN matched_keyword IS NOT NULL THEN 'lexicon' WHEN context_flag THEN 'gemini'
      WHEN toxicity IS NOT NULL THEN 'detoxify' ELSE 'unknown' END AS detection_method,
    CASE WHEN matched_keyword IS NOT NULL THEN 1.0::DOUBLE WHEN context_flag THEN 0.9::DOUBLE WHEN toxicity IS NOT NULL THEN toxicity ELSE 0.0::DOUBLE END AS confidence_score,
    substr(sha256(e.user_id::VARCHAR), 1, 16) AS sender_hash, CASE WHEN e.event_id % 3 = 0 THEN 'system' ELSE 'api' END AS created_by,
    hour(e.ts)::INT AS hour_of_day, dayname(e.ts) AS day_of_week, isodow(e.ts) >= 6 AS is_weekend
  FROM e0 e LEFT JOIN documents d ON d.doc_id = e.event_id LEFT JOIN nation n ON n.n_nationkey = e.user_id % 26 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
), r AS (
  SELECT *, length(text)::INT AS text_length, len(list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f]+'), lambda x: x <> ''))::INT AS word_count,
    regexp_matches(text, 'http[s]?://[a-z$-_!]') AS has_urls, regexp_matches(text, '[@#]\w') AS has_mentions FROM r0
)
"""
_N = "count(*) FILTER (WHERE risk_level = '{0}') AS {1}"
RISKS = ", ".join(_N.format(x, x.lower()) for x in ("HIGH", "MEDIUM", "LOW")) + ", count(*) AS total"
RISKS4 = ", ".join(_N.format(x, x.lower()) for x in ("HIGH", "MEDIUM", "LOW", "UNKNOWN")) + ", count(*) AS total"
PERCENT = ", ".join(f"round({x} / total * 100, 6) AS {x}_percentage" for x in ("high", "medium", "low"))
HEAT = f", heat AS (SELECT *, round((3 * high + 2 * medium + low) / total, 2) AS risk_score, round(high / total * 100, 6) AS high_percentage FROM (SELECT county, {RISKS}, round(coalesce(avg(toxicity), 0), 3) AS avg_toxicity FROM r GROUP BY county))"
LEX = ", lex(priority, term, lvl) AS (VALUES " + ", ".join(map(str, fixtures.LEXICON_ROWS)) + ")"
HIT = "(SELECT l.term FROM lex l WHERE contains(lower({0}), l.term) ORDER BY l.lvl <> 'HIGH', l.priority LIMIT 1)"
CAND = r"""
WITH c0 AS (
  SELECT doc_id AS key, 'https://news.example.org/' || coalesce(source, 'none') || '/' || doc_id AS source_url,
    left(CASE WHEN coalesce(lang, '') <> '' THEN regexp_replace(lang || chr(10) || chr(10) || coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') ELSE coalesce(text, '') END, 5000) AS text FROM documents
), c AS (SELECT *, sha256(trim(regexp_replace(text, '[\s\x0b\x1c-\x1f]+', ' ', 'g'))) AS content_hash FROM c0 WHERE trim(text) <> ''),
stored AS (SELECT source_url, content_hash FROM c WHERE key % 2 = 0),
decided AS (
  SELECT *, CASE WHEN u OR h THEN 'duplicate_skipped' WHEN NOT k THEN 'filter_skipped' ELSE 'verified' END AS action, CASE WHEN u THEN 'url' WHEN h THEN 'content_hash' WHEN NOT k THEN 'no keyword' END AS reason
  FROM (SELECT *, source_url IN (SELECT source_url FROM stored) AS u, content_hash IN (SELECT content_hash FROM stored) AS h, contains(lower(text), 'the') OR contains(lower(text), 'de') AS k FROM c)
)
"""
EV = """
WITH ev AS (
  SELECT event_id AS id, ts, CASE WHEN event_type = 'error' THEN 'HIGH' WHEN value / 100 > 0.7 THEN 'HIGH' WHEN value / 100 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, event_type || ' ' || (user_id % 50) AS t FROM events
)
"""
TIME = "strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp"
DAY = "strftime(timestamp, '%Y-%m-%d')"

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def on_reports(name: str, f, sql: str):
    """A query over reports; sql goes after the reports' definition."""
    QUERIES[name] = lambda spark, d: f(fixtures.reports(spark, d))
    ORACLES[name] = R + sql


def stamped(df):
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


# scans and filters
on_reports("scan_date_range", lambda r: stamped(A.in_range(r, START, END).select("id", "timestamp", "risk_level")), f"SELECT id, {TIME}, risk_level FROM r WHERE timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'")
on_reports("report_by_id", lambda r: A.report_by_id(r, 42).select("id", "text", "county"), "SELECT id, text, county FROM r WHERE id = 42")
on_reports("review_queue", lambda r: A.review_queue(r).select("id", "county"), "SELECT id, county FROM r WHERE risk_level = 'HIGH' AND created_by = 'system'")
on_reports("recent_reports", lambda r: stamped(A.recent(r, 20).select("id", "timestamp", "risk_level")), f"SELECT id, {TIME}, risk_level FROM r ORDER BY r.timestamp DESC, id DESC LIMIT 20")
on_reports("recent_by_status", lambda r: stamped(A.recent(r, 20, "escalated").select("id", "timestamp", "status")), f"SELECT id, {TIME}, status FROM r WHERE status = 'escalated' ORDER BY r.timestamp DESC, id DESC LIMIT 20")
on_reports("max_score", lambda r: r.select("id", E.max_score(F.col("scores")).alias("max_score")), "SELECT id, toxicity AS max_score FROM r")

# columns
on_reports("geo_enrich", lambda r: r.select("id", "county", "region", "is_urban"), "SELECT id, county, region, is_urban FROM r")
on_reports("sender_hash", lambda r: r.select("id", "sender_hash"), "SELECT id, sender_hash FROM r")
on_reports("temporal_fields", lambda r: r.select("id", F.col("hour_of_day").cast("long").alias("hour_of_day"), "day_of_week", "is_weekend"), "SELECT id, hour_of_day::BIGINT AS hour_of_day, day_of_week, is_weekend FROM r")
on_reports("content_fields", lambda r: r.select("id", F.col("text_length").cast("long").alias("text_length"), F.col("word_count").cast("long").alias("word_count"), "has_urls", "has_mentions"), "SELECT id, text_length::BIGINT AS text_length, word_count::BIGINT AS word_count, has_urls, has_mentions FROM r")
on_reports("detection_fields", lambda r: r.select("id", "detection_method", "confidence_score"), "SELECT id, detection_method, confidence_score FROM r")
on_reports(
    "risk_from_scores", lambda r: r.select("id", E.analyser_score(F.col("scores")).alias("score"), E.level_of(E.analyser_score(F.col("scores"))).alias("level")),
    "SELECT id, coalesce(toxicity, 0.5::DOUBLE) AS score, CASE WHEN coalesce(toxicity, 0.5) > 0.7 THEN 'HIGH' WHEN coalesce(toxicity, 0.5) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r",
)
on_reports(
    "explanation", lambda r: r.select("id", E.explanation(F.col("risk_level"), F.col("matched_keyword"), F.col("context_flag"), F.element_at("scores", "toxicity")).alias("explanation")),
    """SELECT id, CASE WHEN p <> '' THEN p WHEN risk_level = 'HIGH' THEN 'Combined signals indicated high risk' WHEN risk_level = 'MEDIUM' THEN 'Combined signals indicated moderate risk' ELSE 'No harmful signals detected' END AS explanation
    FROM (SELECT *, concat_ws(' | ', CASE WHEN matched_keyword IS NOT NULL THEN 'Matched lexicon keyword: ' || matched_keyword END, CASE WHEN context_flag THEN 'Context check flagged hate or incitement risk' END,
      CASE WHEN toxicity >= 0.7 THEN printf('High toxicity score: %.2f', floor(toxicity * 100 + 0.5) / 100) WHEN toxicity >= 0.4 THEN printf('Moderate toxicity score: %.2f', floor(toxicity * 100 + 0.5) / 100) END) AS p FROM r)""",
)
_BI = ["id", "date_only", "hour", "day_number", "weekend", "max_toxicity_score", "toxicity_category", "region_group", "detection_source", "high_confidence", "content_type", "length_category"]
#: Some regions of the test tables under names that have a group.
_GROUPED = "CASE region WHEN 'AFRICA' THEN 'Coast' WHEN 'ASIA' THEN 'Central' WHEN 'EUROPE' THEN 'Western' WHEN 'AMERICA' THEN 'Nyanza' ELSE region END"
on_reports(
    "bi_fields", lambda r: E.bi_fields(r.withColumn("region", F.expr(_GROUPED))).select(*_BI).withColumns({c: F.col(c).cast("long") for c in ("hour", "day_number")}),
    f"""SELECT id, {DAY} AS date_only, hour_of_day::BIGINT AS hour, (dayofweek(timestamp) + 1)::BIGINT AS day_number, dayofweek(timestamp) IN (0, 6) AS weekend, coalesce(toxicity, 0.0::DOUBLE) AS max_toxicity_score,
      CASE WHEN coalesce(toxicity, 0) > 0.7 THEN 'High' WHEN coalesce(toxicity, 0) > 0.4 THEN 'Medium' ELSE 'Low' END AS toxicity_category,
      CASE WHEN region IN ('Nairobi', 'Central') THEN 'Central Kenya' WHEN region IN ('Coast', 'North Eastern') THEN 'Coastal' WHEN region IN ('Rift Valley', 'Western') THEN 'Rift & Western' WHEN region IN ('Nyanza', 'Eastern') THEN 'Other' ELSE 'Unknown' END AS region_group,
      CASE WHEN matched_keyword IS NOT NULL AND context_flag THEN 'Both' WHEN matched_keyword IS NOT NULL THEN 'Lexicon' WHEN context_flag THEN 'Gemini' WHEN detection_method = 'detoxify' THEN 'Detoxify' ELSE 'Unknown' END AS detection_source,
      confidence_score > 0.8 AS high_confidence, CASE WHEN has_urls AND has_mentions THEN 'Rich Content' WHEN has_urls THEN 'With Links' WHEN has_mentions THEN 'With Mentions' ELSE 'Plain Text' END AS content_type,
      CASE WHEN text_length < 50 THEN 'Short' WHEN text_length < 200 THEN 'Medium' ELSE 'Long' END AS length_category FROM (SELECT * REPLACE ({_GROUPED} AS region) FROM r)""",
)

# aggregates
on_reports("risk_distribution", A.risk_distribution, "SELECT d.risk_level, count(r.id) AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNKNOWN')) d(risk_level) LEFT JOIN r ON r.risk_level = d.risk_level GROUP BY 1")
on_reports("risk_share", A.risk_share, "SELECT risk_level, count(*) AS n, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r GROUP BY 1")
on_reports("county_risk", A.county_risk, f"SELECT *, {PERCENT} FROM (SELECT county, {RISKS} FROM r GROUP BY county)")
on_reports("county_risk_filtered", lambda r: A.county_risk(r, "NATION_7"), f"SELECT *, {PERCENT} FROM (SELECT county, {RISKS} FROM r WHERE county = 'NATION_7' GROUP BY county)")
on_reports("keyword_trends", A.keyword_trends, "SELECT matched_keyword, count(*) AS n FROM r WHERE matched_keyword <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
on_reports("toxicity_trends", lambda r: A.toxicity_trends(r, as_of=AS_OF), f"SELECT {DAY} AS date, round(avg(toxicity), 3) AS avg_toxicity, count(*) AS n FROM r WHERE toxicity IS NOT NULL AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1")
on_reports("hourly_patterns", A.hourly_patterns, f"SELECT *, {PERCENT} FROM (SELECT hour_of_day, {RISKS} FROM r GROUP BY 1)")
on_reports("hourly_series", A.hourly_series, f"SELECT hour_of_day, {RISKS}, lpad(hour_of_day::VARCHAR, 2, '0') || ':00' AS label FROM r GROUP BY 1")
on_reports("peak_hours", A.peak_hours, f"SELECT hour_of_day, high FROM (SELECT hour_of_day, {RISKS} FROM r GROUP BY 1) ORDER BY high DESC, hour_of_day LIMIT 5")
on_reports("daily_patterns", A.daily_patterns, f"SELECT *, {PERCENT} FROM (SELECT day_of_week, {RISKS} FROM r GROUP BY 1)")
_KINDS = {"both": "k AND f", "lexicon_only": "k AND NOT f", "context_only": "NOT k AND f", "neither": "NOT k AND NOT f"}
on_reports(
    "detection_comparison", A.detection_comparison,
    "SELECT *, " + ", ".join(f"round({k} / total * 100, 6) AS {k}_percentage" for k in _KINDS) + " FROM (SELECT count(*) AS total, " + ", ".join(f'count(*) FILTER (WHERE {c}) AS "{k}"' for k, c in _KINDS.items()) + " FROM (SELECT matched_keyword IS NOT NULL AS k, context_flag AS f FROM r WHERE risk_level = 'HIGH'))",
)
ORACLES["detection_comparison"] = ORACLES["detection_comparison"].replace("round(both", 'round("both"')
on_reports("geo_heatmap", A.geo_heatmap, HEAT + "SELECT * FROM heat")
on_reports("top_counties_by_risk", A.top_counties_by_risk, HEAT + "SELECT county, risk_score, total FROM heat WHERE lower(county) <> 'unknown' ORDER BY risk_score DESC, county LIMIT 15")
on_reports("top_counties_by_high_pct", A.top_counties_by_high_pct, HEAT + "SELECT county, high_percentage FROM heat ORDER BY high_percentage DESC, county LIMIT 5")
on_reports("county_risk_band", A.county_risk_band, HEAT + "SELECT county, risk_score, CASE WHEN risk_score < 1 THEN 'low' WHEN risk_score < 2 THEN 'medium' ELSE 'high' END AS band FROM heat")
on_reports("detection_risk_matrix", A.detection_risk_matrix, f"SELECT detection_method, {RISKS4} FROM r GROUP BY 1")
on_reports(
    "confidence_histogram", A.confidence_histogram,
    "SELECT printf('%.2f-%.2f', i * 0.1::DOUBLE, (i + 1) * 0.1::DOUBLE) AS bucket, count(*) AS n FROM (SELECT least(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, confidence_score)) / 0.1::DOUBLE), 9) AS i FROM r) GROUP BY 1",
)
on_reports("summary_scalars", A.summary_scalars, "SELECT count(*) AS total, round(coalesce(avg(toxicity), 0), 3) AS avg_toxicity FROM r")
on_reports("summary_top_keywords", A.summary_top_keywords, "SELECT matched_keyword, count(*) AS n FROM r WHERE matched_keyword <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
on_reports("summary_top_counties", A.summary_top_counties, "SELECT county, count(*) AS n FROM r WHERE county <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
on_reports(
    "anomalies", lambda r: A.anomalies(r, 1.5),
    f", d AS (SELECT {DAY} AS date, count(*) AS n FROM r GROUP BY 1), s AS (SELECT avg(n) AS m, stddev_pop(n) AS s FROM d) SELECT date, n, round(m, 1) AS expected, round(abs(n - m) / s, 2) AS deviation FROM d, s WHERE s > 0 AND abs(n - m) > 1.5 * s",
)
on_reports(
    "top_tokens", A.top_tokens,
    r", w AS (SELECT regexp_replace(unnest(string_split_regex(lower(text), '[\s\x0b\x1c-\x1f]+')), '[^\p{L}\p{N}@#]', '', 'g') AS token FROM r WHERE risk_level = 'HIGH') SELECT token, count(*) AS n FROM w WHERE token <> '' AND NOT starts_with(token, 'http') AND (length(token) >= 4 OR token[1] IN ('@', '#')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
on_reports("url_mention_risk", A.url_mention_risk, f", c AS (SELECT risk_level, CASE WHEN has_urls THEN 'with_urls' ELSE 'without_urls' END AS cohort FROM r UNION ALL SELECT risk_level, CASE WHEN has_mentions THEN 'with_mentions' ELSE 'without_mentions' END FROM r) SELECT cohort, {RISKS4} FROM c GROUP BY 1")
on_reports("status_counts", A.status_counts, "SELECT coalesce(s, 'total') AS status, count(*) AS n FROM (SELECT lower(coalesce(nullif(status, ''), 'pending')) AS s FROM r) GROUP BY ROLLUP (s)")
on_reports("alert_batch", lambda r: A.alert(r, AS_OF), f"SELECT 'high_risk_alert' AS event, '{AS_OF}' AS fired_at, 24::BIGINT AS window_hours, count(*) AS n, 10::BIGINT AS threshold FROM r WHERE risk_level = 'HIGH' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND timestamp <= TIMESTAMP '{AS_OF}' HAVING count(*) >= 10")
on_reports("alert_by_county", lambda r: A.alert(r, AS_OF, 240, 2, ["county"]), f"SELECT county, 'high_risk_alert' AS event, '{AS_OF}' AS fired_at, 240::BIGINT AS window_hours, count(*) AS n, 2::BIGINT AS threshold FROM r WHERE risk_level = 'HIGH' AND timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 240 HOUR AND timestamp <= TIMESTAMP '{AS_OF}' GROUP BY county HAVING count(*) >= 2")
on_reports("reports_over_time", A.over_time, f"SELECT {DAY} AS date, count(*) AS n FROM r GROUP BY 1")
on_reports("language_distribution", lambda r: r.groupBy("language").agg(F.count("*").alias("n")), "SELECT language, count(*) AS n FROM r GROUP BY 1")
on_reports("keyword_by_day", lambda r: A.over_time(r.where("matched_keyword <> ''"), "matched_keyword"), f"SELECT {DAY} AS date, matched_keyword, count(*) AS n FROM r WHERE matched_keyword <> '' GROUP BY 1, 2")
on_reports("region_by_day", lambda r: A.over_time(r, "region"), f"SELECT {DAY} AS date, region, count(*) AS n FROM r GROUP BY 1, 2")
on_reports("urban_rural_risk", lambda r: A.risk_counts(r, "is_urban", percent=True), f"SELECT *, {PERCENT} FROM (SELECT is_urban, {RISKS} FROM r GROUP BY 1)")
on_reports("weekend_risk", lambda r: A.risk_counts(r, "is_weekend", percent=True), f"SELECT *, {PERCENT} FROM (SELECT is_weekend, {RISKS} FROM r GROUP BY 1)")
_LONG = "SELECT '{0}' AS section, {1}::VARCHAR AS key, unnest([{2}]) AS metric, unnest([{3}]) AS value FROM ({4})"


def _long(section, key, metrics, sql):
    return _LONG.format(section, key, ", ".join(f"'{m}'" for m in metrics), ", ".join(f"{m}::DOUBLE" for m in metrics), sql)


_C = ["high", "medium", "low", "total"]
BUNDLE = " UNION ALL ".join([
        _long("summary", "'all'", ["total", "avg_toxicity"], "SELECT count(*) AS total, round(coalesce(avg(toxicity), 0), 3) AS avg_toxicity FROM r"),
        _long("risk_distribution", "risk_level", ["n"], "SELECT d.risk_level, count(r.id) AS n FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW'), ('UNKNOWN')) d(risk_level) LEFT JOIN r ON r.risk_level = d.risk_level GROUP BY 1"),
        _long("county", "county", _C, f"SELECT county, {RISKS} FROM r GROUP BY 1"), _long("keywords", "matched_keyword", ["n"], "SELECT matched_keyword, count(*) AS n FROM r WHERE matched_keyword <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        _long("toxicity", "date", ["avg_toxicity", "n"], f"SELECT {DAY} AS date, round(avg(toxicity), 3) AS avg_toxicity, count(*) AS n FROM r WHERE toxicity IS NOT NULL GROUP BY 1"),
        _long("hourly", "hour_of_day", _C, f"SELECT hour_of_day, {RISKS} FROM r GROUP BY 1"), _long("daily", "day_of_week", _C, f"SELECT day_of_week, {RISKS} FROM r GROUP BY 1"),
    ])
on_reports("dashboard_bundle", A.bundle, BUNDLE)

_IN = f"timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'"


@query(
    "dashboard_view",
    R + ", v AS (SELECT * FROM r WHERE " + _IN + ") SELECT *, TIMESTAMP '" + START + "' AS range_start, TIMESTAMP '" + END + "' AS range_end, TIMESTAMP '" + AS_OF + "' AS generated_at FROM (" + BUNDLE.replace("FROM r", "FROM v").replace("JOIN r ON r.", "JOIN v ON v.").replace("count(r.id)", "count(v.id)") + ")",
)
def _dashboard_view(spark, d):
    """The bundle of a range from a view that was stored for a part of the reports and then kept up."""
    at, path = scratch_path(spark, "reports"), scratch_path(spark, "view")
    r = fixtures.reports(spark, d).select("id", "timestamp", "county", "risk_level", "matched_keyword", "hour_of_day", "day_of_week", "scores")
    view = DayView(spark, at, path)
    for part in (r.where(F.col("risk_level") != "LOW"), r.where("risk_level = 'LOW'")):
        sinks.save_reports(part, at)
        view.refresh()
    return view.bundle(START, END, AS_OF)


# exports
_FLAT = f"""SELECT id::VARCHAR AS id, text, risk_level, language, county, region, is_urban, strftime(r.timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, strftime(r.timestamp, '%Y-%m-%d') AS date, strftime(r.timestamp, '%H:%M:%S') AS time,
  hour_of_day::VARCHAR AS hour_of_day, day_of_week, is_weekend, text_length::BIGINT AS text_length, word_count::BIGINT AS word_count, has_urls, has_mentions, detection_method, confidence_score, coalesce(matched_keyword, '') AS matched_keyword, context_flag,
  coalesce(toxicity, 0.0::DOUBLE) AS toxicity, {', '.join(f'0.0::DOUBLE AS {n}' for n in sinks.SCORE_NAMES[1:])}, coalesce(toxicity, 0.0::DOUBLE) AS max_toxicity, sender_hash FROM r"""
on_reports("export_flat", lambda r: sinks.flatten(r.orderBy(F.desc("timestamp"), F.desc("id"))), _FLAT)
on_reports("export_flat_fields", lambda r: sinks.select_fields(sinks.flatten(r), ["county", "id", "nothing", "max_toxicity"]), f"SELECT county, id, max_toxicity FROM ({_FLAT})")


@query("export_json", R + "SELECT id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, risk_level, county, toxicity, matched_keyword FROM r")
def _export_json(spark, d):
    path = scratch_path(spark, "export-json")
    sinks.export_json(fixtures.reports(spark, d).select("id", "timestamp", "risk_level", "county", "scores", "matched_keyword"), path)
    back = spark.read.schema("id long, timestamp string, risk_level string, county string, scores map<string,double>, matched_keyword string").json(path)
    return back.withColumn("toxicity", F.element_at("scores", "toxicity")).drop("scores")


on_reports(
    "enrich_reports", lambda r: r.select("id", "region", "is_urban", "day_of_week", "text_length", "detection_method", "confidence_score", F.coalesce("status", F.lit("pending")).alias("status")),
    "SELECT id, region, is_urban, day_of_week, text_length, detection_method, confidence_score, coalesce(status, 'pending') AS status FROM r",
)
QUERIES["enrich_reports"] = lambda spark, d: sinks.enrich_reports(fixtures.reports(spark, d), fixtures.places(spark, d)).select("id", "region", "is_urban", "day_of_week", "text_length", "detection_method", "confidence_score", "status")


# lexicon and classification
def _docs(spark, d):
    return fixtures.table(spark, d, "documents")


@query("lexicon_match", f"WITH q AS (SELECT 1) {LEX} SELECT doc_id, {HIT.format('text')} AS matched_term, (SELECT lvl FROM lex WHERE term = {HIT.format('text')}) AS lexicon_level FROM documents")
def _lexicon_match(spark, d):
    return C.lexicon_match(_docs(spark, d), fixtures.lexicon(spark)).select("doc_id", "matched_term", "lexicon_level")


def _phrases(spark, d):
    """A lexicon from the given tables: the words of the benchmark items of four letters and more, and their pairs."""
    w = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 4)
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.col("w")[i + 1]))
    terms = fixtures.table(spark, d, "benchmark").select(w.alias("w")).select(F.explode(F.concat("w", pairs)).alias("term")).distinct()
    return terms.withColumns({"priority": F.length("term"), "risk_level": F.when(F.ascii(F.right("term", F.lit(1))) % 2 == 0, "HIGH").otherwise("MEDIUM")})


@query(
    "lexicon_match_large",
    r"""WITH w AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4) AS w FROM benchmark),
    lex AS (SELECT DISTINCT term, length(term) AS priority, CASE WHEN ascii(right(term, 1)) % 2 = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS lvl
      FROM (SELECT unnest(w) AS term FROM w UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w)),
    hit AS (SELECT doc_id, arg_min(struct_pack(t := term, l := lvl), struct_pack(a := lvl <> 'HIGH', b := priority, c := term)) AS h FROM documents JOIN lex ON contains(lower(text), term) GROUP BY doc_id)
    SELECT documents.doc_id, h.t AS matched_term, h.l AS lexicon_level FROM documents LEFT JOIN hit USING (doc_id)""",
)
def _lexicon_match_large(spark, d):
    return lexicon_match_large(_docs(spark, d), _phrases(spark, d)).select("doc_id", "matched_term", "lexicon_level")


@query("keyword_context", f"WITH q AS (SELECT 1) {LEX} SELECT doc_id, CASE WHEN t IN ('erblest', 'ththre') THEN 'Term ' || t || ' is on the watch list.' ELSE '{E.DEFAULT_CONTEXT}' END AS keyword_context FROM (SELECT doc_id, {HIT.format('text')} AS t FROM documents) WHERE t IS NOT NULL")
def _keyword_context(spark, d):
    lex = fixtures.lexicon(spark)
    return C.keyword_context(C.lexicon_match(_docs(spark, d), lex).where("matched_term is not null"), lex).select("doc_id", "keyword_context")


def _said(lang):
    return "CASE risk_level WHEN 'HIGH' THEN '{HIGH}' WHEN 'MEDIUM' THEN '{MEDIUM}' ELSE '{LOW}' END AS ".format(**E.MESSAGES[lang]) + lang


on_reports("response_messages", lambda r: C.response_messages(r).select("id", "messages.*"), f"SELECT id, {', '.join(map(_said, E.MESSAGES))} FROM r")


@query(
    "classify",
    R + LEX + f""", m AS (SELECT id, toxicity, context_flag, {HIT.format('text')} AS term FROM r), k AS (SELECT m.*, (SELECT lvl FROM lex WHERE lex.term = m.term) AS lvl, coalesce(toxicity, 0.5) AS s FROM m),
    b AS (SELECT *, CASE WHEN s > 0.7 THEN 'HIGH' WHEN s >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS by_score FROM k)
    SELECT id, term AS matched_keyword, CASE WHEN lvl = 'HIGH' OR context_flag THEN 'HIGH' WHEN lvl = 'MEDIUM' AND by_score = 'LOW' THEN 'MEDIUM' ELSE by_score END AS risk_level FROM b""",
)
def _classify(spark, d):
    r = fixtures.reports(spark, d).select("id", "text", "scores", "context_flag")
    return C.classify(r, fixtures.lexicon(spark)).select("id", "matched_keyword", "risk_level")


@query(
    "lexicon_extend",
    f"""WITH q AS (SELECT 1) {LEX}, more AS (SELECT DISTINCT trim(string_split(text, ' ')[1]) AS term, CASE doc_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM documents),
    new AS (SELECT term, risk_level FROM more m WHERE term <> '' AND risk_level <> 'LOW' AND NOT EXISTS (SELECT 1 FROM lex l WHERE l.term = m.term AND l.lvl = m.risk_level))
    SELECT priority, term, lvl AS risk_level FROM lex UNION ALL SELECT (7 + row_number() OVER (ORDER BY risk_level, term))::INT, term, risk_level FROM new""",
)
def _lexicon_extend(spark, d):
    guess = F.when(F.col("doc_id") % 3 == 0, " high").when(F.col("doc_id") % 3 == 1, "Medium ").otherwise("low")
    more = _docs(spark, d).select(F.substring_index("text", " ", 1).alias("term"), guess.alias("risk_level_guess"))
    return readers.extend_lexicon(fixtures.lexicon(spark), more).select("priority", "term", "risk_level")


# candidates and ingestion
@query("feed_snippet", r"SELECT page_id, left(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x0b\x1c-\x1f]+', ' ', 'g')), 5000) AS snippet FROM pages")
def _feed_snippet(spark, d):
    return fixtures.table(spark, d, "pages").select("page_id", readers.snippet(F.lit(""), F.col("html")).alias("snippet"))


@query("text_unwrap", "SELECT doc_id, trim(text) AS text FROM documents")
def _text_unwrap(spark, d):
    kept = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("['"), F.replace(F.trim("text"), F.lit("'"), F.lit("\\'")), F.lit("']"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", X.unwrap_list(kept).alias("text"))


def _allowed(pages):
    """A table of allowed hosts: those of the organisations among all hosts."""
    return pages.select(X.url_host(F.col("url")).alias("host")).where("host like '%.org'").distinct()


@query("domain_allow", "SELECT page_id, url FROM pages WHERE lower(regexp_replace(regexp_extract(url, '^[^:]+://([^/?#]*)', 1), ':[0-9]*$', '')) LIKE '%.org'")
def _domain_allow(spark, d):
    pages = fixtures.table(spark, d, "pages")
    return I.domain_allow(pages, _allowed(pages)).select("page_id", "url")


@query(
    "normalise_url",
    r"""WITH u AS (SELECT page_id, regexp_extract(trim(url), '^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS p FROM pages),
    q AS (SELECT page_id, p, list_filter(list_transform(string_split(p.query, '&'), lambda x: [url_decode(split_part(x, '=', 1)), url_decode(regexp_extract(x, '^[^=]*=(.*)$', 1))]), lambda x: x[2] <> '' AND lower(x[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid')) AS q FROM u)
    SELECT page_id, lower(p.scheme) || '://' || p.host || CASE WHEN p.path = '' THEN '/' ELSE regexp_replace(p.path, ';[^/]*$', '') END
      || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda x: url_encode(x[1]) || '=' || url_encode(x[2])), '&') ELSE '' END AS url FROM q""",
)
def _normalise_url(spark, d):
    return fixtures.table(spark, d, "pages").select("page_id", X.normalise_url(F.col("url")).alias("url"))


@query("page_candidates")
def _page_candidates(spark, d):
    pages = fixtures.table(spark, d, "pages")
    return readers.page_candidates(pages, _allowed(pages))


def _escaped(c):
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _rooted(batches):
    """Each file a feed of its own."""
    yield pd.DataFrame({"value": ["<rss><channel>"]})
    yield from batches
    yield pd.DataFrame({"value": ["</channel></rss>"]})


def _landed_feeds(spark, d):
    """The folder of feed files that the documents make."""
    path = scratch_path(spark, "feeds")
    c = fixtures.feed_side(spark, d)
    items = c.select(F.concat(F.lit("<item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><description>"), _escaped("snippet"), F.lit("</description></item>")).alias("value"))
    items.mapInPandas(_rooted, "value string").write.text(path)
    return path


_FEED = """SELECT 'https://news.example.org/' || coalesce(source, 'none') || '/' || doc_id AS url, coalesce(lang, '') AS title, left(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g')), 5000) AS snippet,
    'rss' AS source_type, 'https://news.example.org/feed' AS source_feed FROM documents"""


@query("feed_candidates", _FEED)
def _feed_candidates(spark, d):
    return readers.feed_candidates(spark, _landed_feeds(spark, d), "https://news.example.org/feed")


@query("landed_feed_items", _FEED)
def _landed_feed_items(spark, d):
    """The same files through the data source, as a stream that is read to its end."""
    items = landed_feeds.feed_items(spark, _landed_feeds(spark, d), stream=True, endings=".txt")
    return landed_feeds.candidates_of(jobs.run_to_files(items), "https://news.example.org/feed")


@query(
    "dataset_import",
    r"""SELECT text, county FROM (SELECT regexp_replace(text, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS text, CASE WHEN trim(source) <> '' AND lower(trim(source)) <> 'nan' THEN trim(source) END AS county FROM documents) WHERE text <> ''""",
)
def _dataset_import(spark, d):
    path = scratch_path(spark, "dataset")
    _docs(spark, d).select("doc_id", F.col("text").alias("Tweet"), F.col("source").alias("county")).write.option("header", True).option("escape", '"').csv(path)
    return readers.dataset_import(spark, path)


@query("candidate_text", CAND + "SELECT key, text FROM c0")
def _candidate_text(spark, d):
    return fixtures.feed_side(spark, d).select("key", X.candidate_text(F.col("title"), F.col("snippet")).alias("text"))


@query("content_hash", r"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\x0b\x1c-\x1f]+', ' ', 'g'))) AS content_hash FROM documents")
def _content_hash(spark, d):
    return _docs(spark, d).select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


@query("candidate_union", "SELECT source_type, count(*) AS n, count(DISTINCT f) AS feeds FROM (SELECT 'rss' AS source_type, 'x' AS f FROM documents UNION ALL SELECT 'scraped', NULL FROM pages) GROUP BY 1")
def _candidate_union(spark, d):
    pages = fixtures.table(spark, d, "pages").select(F.col("page_id").alias("key"), "url", F.lit("").alias("title"), F.col("html").alias("snippet"), F.lit("scraped").alias("source_type"))
    return I.union_candidates(fixtures.feed_side(spark, d), pages).groupBy("source_type").agg(F.count("*").alias("n"), F.countDistinct("source_feed").alias("feeds"))


@query("relevance_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'de')")
def _relevance_filter(spark, d):
    return I.relevance_filter(_docs(spark, d), KEYWORDS).select("doc_id")


def _prepared(spark, d):
    return I.prepare(fixtures.feed_side(spark, d))


@query("dedupe_url", CAND + "SELECT key, source_url FROM c WHERE source_url NOT IN (SELECT source_url FROM stored)")
def _dedupe_url(spark, d):
    return I.dedupe(_prepared(spark, d), fixtures.stored(spark, d), "source_url").select("key", "source_url")


@query("dedupe_content", CAND + "SELECT key, content_hash FROM c WHERE content_hash NOT IN (SELECT content_hash FROM stored)")
def _dedupe_content(spark, d):
    return I.dedupe(_prepared(spark, d), fixtures.stored(spark, d), "content_hash").select("key", "content_hash")


def _decided(spark, d):
    return I.decide(_prepared(spark, d), fixtures.stored(spark, d), KEYWORDS)


@query("ingestion_audit", CAND + "SELECT 'job-1' AS job_id, action, 'rss' AS source_type, source_url AS url, reason FROM decided")
def _ingestion_audit(spark, d):
    return I.audit(_decided(spark, d), "job-1", AS_OF).select("job_id", "action", "source_type", "url", "reason")


@query("ingestion_counts", CAND + "SELECT coalesce(action, 'fetched') AS outcome, count(*) AS n FROM decided GROUP BY ROLLUP (action)")
def _ingestion_counts(spark, d):
    return I.outcome_counts(_prepared(spark, d), fixtures.stored(spark, d), KEYWORDS)


@query("ingestion_by_filters", CAND + "SELECT key, action, reason FROM decided")
def _ingestion_by_filters(spark, d):
    """The decisions against a store of keys: filters first, an exact join with the bucketed keys for what they let through."""
    store = KeyStore.create(spark, scratch_path(spark, "keys"), expected=100_000)
    store.add(I.store_keys(fixtures.stored(spark, d)))
    return I.decide(_prepared(spark, d), store, KEYWORDS).select("key", "action", "reason")


# a model of one's own
@query("risk_model")
def _risk_model(spark, d):
    """Documents with labels, their score by a model that has seen two thirds of them, and the level that comes of it."""
    labels = fixtures.table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    known = _docs(spark, d).select("doc_id", "text").join(labels, "doc_id")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = risk_model.fit(known.where(~held_out), "doc_id")
    scored = model.score(known, "doc_id")
    level = risk_model.ensemble(F.lit("LOW"), F.col("custom_risk_score"))
    return scored.select("doc_id", held_out.alias("held_out"), "label", F.round("custom_risk_score", 6).alias("custom_risk_score"), level.alias("risk_level"))


# streams
def _name(kind):
    return f"{kind}_{uuid.uuid4().hex}"


@query("alert_stream", EV + ", w AS (SELECT unnest(range(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM ev WHERE risk_level = 'HIGH') SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM w GROUP BY s HAVING count(*) >= 10")
def _alert_stream(spark, d):
    w = jobs.run_to_table(jobs.alert_windows(fixtures.event_stream(spark, d)), _name("alerts"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query(
    "alert_crossings",
    EV + """, h AS (SELECT 'all' AS key, epoch_ms(ts) AS t FROM ev WHERE risk_level = 'HIGH'), one AS (SELECT key, t, count(*) AS c FROM h GROUP BY ALL), passed AS (SELECT max(t) - 3600000 AS w FROM h),
    moments AS (SELECT key, t FROM one UNION SELECT key, t + 3 * 3600000 FROM one), counted AS (SELECT m.key, m.t, coalesce(sum(o.c), 0) AS n FROM moments m LEFT JOIN one o ON o.key = m.key AND o.t > m.t - 3 * 3600000 AND o.t <= m.t GROUP BY ALL)
    SELECT key, 'high_risk_alert' AS event, strftime(make_timestamp(t * 1000), '%Y-%m-%d %H:%M:%S') AS fired_at, n::BIGINT AS n, 3::BIGINT AS window_hours, 8::BIGINT AS threshold
    FROM (SELECT *, lag(n) OVER (PARTITION BY key ORDER BY t) AS prev FROM counted), passed WHERE n >= 8 AND coalesce(prev, 0) < 8 AND t <= w""",
)
def _alert_crossings(spark, d):
    """Three hours with eight HIGH reports and more, each time they are reached."""
    with alerts.state_store(spark):
        fired = jobs.run_to_files(alerts.alert_crossings(fixtures.event_stream(spark, d), None, 3, 8))
    return fired.withColumn("fired_at", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss"))


@query("live_counters_stream", EV + "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, risk_level, count(*) AS n FROM ev GROUP BY 1, 2")
def _live_counters(spark, d):
    w = jobs.run_to_table(jobs.live_counters(fixtures.event_stream(spark, d)), _name("counters"))
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "risk_level", "n")


@query("dedupe_stream", CAND + "SELECT DISTINCT content_hash FROM c")
def _dedupe_stream(spark, d):
    """The content hashes of all candidates as a file stream."""
    landed = scratch_path(spark, "hashes")
    I.prepare(fixtures.feed_side(spark, d)).select("content_hash", F.lit(AS_OF).cast("timestamp").alias("timestamp")).write.parquet(landed)
    return jobs.run_to_files(jobs.dedupe(spark.readStream.schema("content_hash string, timestamp timestamp").parquet(landed)).select("content_hash"))


@query("ingest_stream", CAND + "SELECT source_url, content_hash FROM c WHERE contains(lower(text), 'the') OR contains(lower(text), 'de')")
def _ingest_stream(spark, d):
    """The candidates of all documents as a file stream, into an empty store."""
    store, check, landed = (scratch_path(spark, n) for n in ("store", "checkpoint", "landed"))
    c = fixtures.feed_side(spark, d)
    c.write.parquet(landed)
    q = jobs.start_ingest(spark.readStream.schema(c.schema).parquet(landed), store, fixtures.lexicon(spark), check, KEYWORDS)
    q.awaitTermination()
    return CommitLog(spark, store).read("reports", jobs.STORED).select("source_url", "content_hash")
