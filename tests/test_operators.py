from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.operators import analytics as A
from veriscope.operators import classify as C
from veriscope.operators import ingest as I
from veriscope.sources import readers, sinks

T0 = datetime(2024, 3, 1, 9)
#: id, day, hour, level, county, keyword, toxicity
SIX = [(1, 0, 9, "MEDIUM", "Lamu", "dusty", 0.61), (2, 0, 22, "LOW", "Lamu", None, None), (3, 2, 9, "HIGH", "Turkana", "dusty", 0.97), (4, 4, 5, "LOW", None, None, 0.05), (5, 4, 6, "HIGH", "Wajir", "gravel", 0.71), (6, 7, 1, "MEDIUM", "Turkana", "pebble", 0.4)]
ROWS = [(i, T0.replace(hour=hour) + timedelta(days=day), level, county, word, None if tox is None else {"toxicity": tox}) for i, day, hour, level, county, word, tox in SIX]


@pytest.fixture(scope="module")
def six(spark):
    d = spark.createDataFrame(ROWS, "id long, timestamp timestamp, risk_level string, county string, matched_keyword string, scores map<string,double>")
    d = d.withColumns({"context_flag": F.lit(None).cast("boolean"), "text": F.lit("see http://x"), "status": F.when(F.col("id") == 1, "Reviewed")})
    return E.detection_fields(E.content_fields(E.temporal_fields(d)))


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_six_reports(six):
    assert dict(rows(A.risk_distribution(six))) == {"HIGH": 2, "MEDIUM": 2, "LOW": 2, "UNKNOWN": 0}
    assert rows(A.summary_scalars(six)) == [(6, 0.548)]
    assert rows(A.detection_comparison(six))[0][:5] == (2, 0, 2, 0, 0)
    assert dict(rows(A.status_counts(six))) == {"pending": 5, "reviewed": 1, "total": 6}
    assert [r[0] for r in rows(A.recent(six, 2))] == [6, 5]
    assert rows(A.keyword_trends(six)) == [("dusty", 2), ("gravel", 1), ("pebble", 1)]
    assert {r[0]: r[1:] for r in rows(A.url_mention_risk(six))}["with_mentions"] == (0, 0, 0, 0, 0)


def test_unknown_counts_in_total_only(spark, six):
    d = six.withColumn("risk_level", F.lit("UNKNOWN"))
    assert rows(A.county_risk(d.where("id = 1")).select("high", "total", "high_percentage")) == [(0, 1, 0.0)]


def test_ranges(six):
    assert A.in_range(six, T0, T0 + timedelta(days=1)).count() == 2
    assert A.in_range(six, "2024-03-01", "2024-03-01").count() == 0
    assert A.in_range(six, "2024-03-01", "2024-03-01", end_of_day=True).count() == 2


def test_histogram_keeps_double_division(spark):
    d = spark.createDataFrame([(0.3,), (1.0,), (-1.0,), (1.7,), (None,)], "confidence_score double")
    assert dict(rows(A.confidence_histogram(d))) == {"0.20-0.30": 1, "0.90-1.00": 2, "0.00-0.10": 1}
    assert dict(rows(A.confidence_histogram(d, 0.3)))["0.60-0.90"] == 2
    with pytest.raises(ValueError):
        A.confidence_histogram(d, 0.9)


def test_spike_is_an_anomaly_and_alert(spark):
    calm = [(T0 + timedelta(days=i), "LOW") for i in range(10)]
    spike = [(T0 + timedelta(days=10, hours=h), "HIGH") for h in range(10) for _ in range(3)]
    d = spark.createDataFrame(calm + spike, "timestamp timestamp, risk_level string")
    assert [r["date"] for r in A.anomalies(d).collect()] == ["2024-03-11"]
    assert A.alert(d, T0 + timedelta(days=11)).first()["n"] == 30
    assert A.alert(d, T0 + timedelta(days=5)).count() == 0


def test_empty(spark, six):
    none = six.where("id < 0")
    assert A.geo_heatmap(none).count() == 0 and A.anomalies(none).count() == 0 and A.detection_comparison(none).first()["both_percentage"] is None
    flat = sinks.flatten(none.withColumns({"language": F.lit("en"), "region": F.lit("x"), "is_urban": F.lit(True), "sender_hash": F.lit("h")}))
    assert flat.count() == 0 and len(flat.columns) == 29


def test_fields_and_exports(spark, six, tmp_path):
    flat = sinks.flatten(six.withColumns({"language": F.lit("en"), "region": F.lit("x"), "is_urban": F.lit(True), "sender_hash": F.lit("h")}))
    assert sinks.select_fields(flat, ["county", "no", "id"]).columns == ["county", "id"]
    sinks.export_aggregate(six, "risk_distribution", str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 4
    with pytest.raises(ValueError):
        sinks.export_aggregate(six, "nothing", str(tmp_path / "b"))


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([(1, "bad", "HIGH", "Why bad."), (2, "bad thing", "HIGH", None), (3, "meh", "MEDIUM", None)], "priority int, term string, risk_level string, context string")


def test_classification(spark, lexicon):
    texts = [("a BAD thing", {"toxicity": 0.1}, False), ("meh", {"toxicity": 0.1}, False), ("ok", {"toxicity": 0.1}, True), ("ok", {"toxicity": 0.75}, None), ("ok", {"error": 1.0}, None), (None, None, None)]
    d = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, text string, scores map<string,double>, context_flag boolean")
    got = C.classify(d, lexicon).orderBy("i").collect()
    assert [(r["risk_level"], r["matched_keyword"]) for r in got] == [("HIGH", "bad"), ("MEDIUM", "meh"), ("HIGH", None), ("HIGH", None), ("MEDIUM", None), ("MEDIUM", None)]
    assert got[0]["scores"] == {"lexicon_match": 1.0} and got[3]["explanation"] == "High toxicity score: 0.75"
    said = C.response_messages(C.keyword_context(C.lexicon_match(d, lexicon), lexicon).withColumn("risk_level", F.lit("HIGH")), keyword="matched_term").where("i = 0").first()
    assert said["messages"]["english"].endswith("Why bad.")
    whole = C.lexicon_match(spark.createDataFrame([("badge",)], "text string"), lexicon, word_boundary=True).first()
    assert whole["matched_term"] is None


def test_scorer_runs_on_unsettled_messages_only(spark, lexicon):
    d = spark.createDataFrame([("bad",), ("fine",)], "text string").withColumns({"scores": F.lit(None).cast("map<string,double>"), "context_flag": F.lit(None).cast("boolean")})

    def scorer(texts):
        assert "bad" not in texts
        return [{"toxicity": 0.9} for _ in texts]

    assert {r["text"]: r["risk_level"] for r in C.classify(d, lexicon, scorer).collect()} == {"bad": "HIGH", "fine": "HIGH"}


def test_ingestion_decisions(spark, lexicon):
    c = spark.createDataFrame([("https://e.com/1?utm_source=x", "T", "the a"), ("https://e.com/2", "T", "the b"), ("https://e.com/3", "T", "nothing"), ("https://e.com/4", "T", "the new"), ("", "T", "x"), ("https://e.com/5", "", "")], "url string, title string, snippet string")
    c = c.withColumn("source_type", F.lit("rss"))
    p = I.prepare(c)
    stored = p.where("source_url = 'https://e.com/1'").select("source_url", F.lit("z").alias("content_hash")).union(p.where("source_url = 'https://e.com/2'").select(F.lit("u"), "content_hash"))
    done = I.run_cycle(c, stored, lexicon, ["THE"])
    assert {r["source_url"][-1]: (r["action"], r["reason"]) for r in done.collect()} == {"1": ("duplicate_skipped", "url"), "2": ("duplicate_skipped", "content_hash"), "3": ("filter_skipped", "no keyword"), "4": ("verified", None)}
    assert dict(rows(I.counters(done))) == {"fetched": 4, "duplicate_skipped": 2, "filter_skipped": 1, "verified": 1}
    assert I.audit(done, "j", "2024-01-01").count() == 4


def test_feeds_and_tables(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Rain &amp; roads</title><link>https://roads.example.org/a/b#map</link><description>&lt;i&gt;Two bridges\n shut&lt;/i&gt;</description></item><item><title>nowhere to go</title></item></channel></rss>")
    assert rows(readers.feed_candidates(spark, str(tmp_path / "f.xml")).select("url", "title", "snippet")) == [("https://roads.example.org/a/b", "Rain & roads", "Two bridges shut")]
    (tmp_path / "d.csv").write_text("id,Tweet,location\n1,\"['hi \\'you\\'']\",nan\n2,,X\n3, b , Y \n")
    assert {r["county"] for r in readers.dataset_import(spark, str(tmp_path / "d.csv")).collect()} == {None, "Y"}
    pages = spark.createDataFrame([("https://a.org:80/x", "<title>T &amp; U</title><nav>menu</nav><p>Body</p>"), ("https://b.org/", "<p>x</p>")], "url string, html string")
    assert rows(readers.page_candidates(pages, ["A.org"]).select("title", "snippet")) == [("T & U", "T & U\n\nBody")]
    assert readers.pick(["A", "Text"], readers.TEXT_NAMES, "A", any_case=True) == "Text"


def test_lexicon_extension(spark, lexicon):
    more = spark.createDataFrame([(" new ", "high"), ("bad", "HIGH"), ("meh", "High"), ("x", "low"), (None, "HIGH")], "term string, risk_level_guess string")
    got = {(r["term"], r["risk_level"]): r["priority"] for r in readers.extend_lexicon(lexicon, more).collect()}
    assert len(got) == 5 and got[("meh", "HIGH")] == 4 and got[("new", "HIGH")] == 5


def test_large_lexicons(spark, lexicon):
    n = C.LEXICON_ROWS + 1000
    large = spark.range(n).select(F.concat(F.lit("term"), "id", F.lit("x")).alias("term"), F.when(F.col("id") % 2 == 0, "HIGH").otherwise("MEDIUM").alias("risk_level"), F.col("id").cast("int").alias("priority"), F.concat(F.lit("about "), "id").alias("context"))
    d = spark.createDataFrame([(f"Term{n - 1}X, term{n - 2}x and term{n - 4}x",), (f"term{n - 1}x",), ("nothing",), (None,)], "text string")
    got = C.keyword_context(C.lexicon_match_join(d, large), large).collect()
    assert sorted([(r["matched_term"], r["lexicon_level"], r["keyword_context"]) for r in got], key=str) == sorted([(f"term{n - 4}x", "HIGH", f"about {n - 4}"), (f"term{n - 1}x", "MEDIUM", f"about {n - 1}"), *[(None, None, E.DEFAULT_CONTEXT)] * 2], key=str)
    every = spark.range(n).select(F.concat(F.lit("term"), "id", F.lit("x")).alias("matched_term"))
    assert C.keyword_context(every, large).where(F.col("keyword_context") == E.DEFAULT_CONTEXT).count() == 0
    texts = d.unionByName(spark.createDataFrame([("badge",), ("a BAD one",), ("",)], "text string"))
    for whole in (False, True):
        same = [sorted(f(texts, lexicon, word_boundary=whole).collect(), key=str) for f in (C.lexicon_match, C.lexicon_match_join)]
        assert same[0] == same[1]


def test_outcomes_of_scorers(spark, lexicon):
    d = spark.createDataFrame([(t,) for t in ("bad", "fine", "breaks", "so so", None)], "text string").withColumns({"scores": F.lit(None).cast("map<string,double>"), "context_flag": F.lit(None).cast("boolean")}).coalesce(1)

    def scorer(texts):
        if "breaks" in texts:
            raise RuntimeError("no")
        return [{"toxicity": 0.9 if t == "fine" else 0.1} for t in texts]

    def context(texts):
        if any(t == "" for t in texts):
            raise ValueError("no text")
        return [(t == "so so", "coded" if t == "so so" else "") for t in texts]

    got = {r["text"]: r for r in C.classify(d, lexicon, scorer, context).collect()}
    assert [(t, got[t]["score_outcome"], got[t]["context_outcome"], got[t]["context_reason"], got[t]["risk_level"]) for t in got] == [
        ("bad", None, None, None, "HIGH"), ("fine", "ok", "ok", None, "HIGH"), ("breaks", "error", "ok", None, "MEDIUM"), ("so so", "ok", "ok", "coded", "HIGH"), (None, "ok", "error", None, "LOW"),
    ]
    assert got["breaks"]["scores"] == {"toxicity": 0.5, "error": 1.0}

    def none(texts):
        raise C.ModelUnavailable

    got = {r["text"]: r for r in C.classify(d, lexicon, none).collect()}
    assert got["fine"]["scores"] == {"toxicity": 0.5, "fallback": 1.0} and got["fine"]["score_outcome"] == "fallback" and got["bad"]["scores"] == {"lexicon_match": 1.0}
    short = C.outcomes_of(lambda ts: [1] * (len(ts) - 1 if len(ts) > 1 else 1), ["a", "b"], 0, -1)
    assert short == [(1, "ok"), (1, "ok")]  # too few results for a batch: one by one


def test_length_of_messages(spark, lexicon):
    d = spark.createDataFrame([(t,) for t in ("bad", "", None, "x" * 5000, "x" * 5001)], "text string").withColumns({"scores": F.lit(None).cast("map<string,double>"), "context_flag": F.lit(None).cast("boolean")})
    assert sorted(len(r["text"]) for r in C.classify(d, lexicon, max_length=C.MESSAGE_LENGTH).collect()) == [3, 5000]
    assert sorted(rows(C.outside_length(d).select("reason"))) == [("empty text",), ("empty text",), ("text too long",)]
    assert C.classify(d, lexicon).count() == 5


def test_sinks(spark, six, tmp_path):
    full = six.withColumns({"language": F.lit("en"), "region": F.lit("x"), "is_urban": F.lit(True), "sender_hash": F.lit("h")})
    many = full.crossJoin(spark.range(40).withColumnRenamed("id", "k")).withColumn("id", F.col("id") * 100 + F.col("k")).drop("k").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # else so few rows are one file
    sinks.export_csv(many, str(tmp_path / "csv"), fields=["id", "timestamp"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = [r["file"] for r in sinks.export_order(spark, str(tmp_path / "csv")).collect()]
    lines = [tuple(line.split(",")) for f in order for line in (tmp_path / "csv" / f).read_text().splitlines()[1:]]
    want = sorted(((str(i), t.strftime("%Y-%m-%dT%H:%M:%S")) for i, t in rows(many.select("id", "timestamp"))), key=lambda x: (x[1], int(x[0])), reverse=True)
    assert lines == want and len(order) > 1
    for start in (None, T0 + timedelta(days=2)):
        at = tmp_path / f"pack{start is None}"
        sinks.export_pack(full, str(at), start)
        ids = {int(r["id"]) for r in spark.read.option("header", True).csv(str(at / "reports")).collect()}
        summary = {r["risk_level"]: r["n"] for r in spark.read.json(str(at / "summary")).collect()}
        assert ids == {i for i, t in rows(full.select("id", "timestamp")) if start is None or t >= start} and sum(summary.values()) == len(ids) and set(summary) == {"HIGH", "MEDIUM", "LOW", "UNKNOWN"}
    counts = spark.createDataFrame([("fetched", 5), ("verified", 2)], "outcome string, n long")
    for job in ("one", "two"):  # the last run alone is kept
        sinks.save_last_run(counts, job, "2024-01-30 10:00:00", str(tmp_path / "last"))
    assert [(r["job_id"], r["counts"], str(r["finished_at"])) for r in sinks.last_run(spark, str(tmp_path / "last")).collect()] == [("two", {"fetched": 5, "verified": 2}, "2024-01-30 10:00:00")]
    sinks.save_reports(full, str(tmp_path / "reports"))
    sinks.save_reports(full.limit(1), str(tmp_path / "reports"))
    back = spark.read.parquet(str(tmp_path / "reports"))
    assert back.count() == 7 and {str(d) for (d,) in rows(back.select("date"))} == {str(t.date()) for (t,) in rows(full.select("timestamp"))}
    for name in sorted(sinks.EXPORTS):
        sinks.export_aggregate(full, name, str(tmp_path / name))
        assert spark.read.option("header", True).csv(str(tmp_path / name)).count() == sinks.EXPORTS[name](full).count()
