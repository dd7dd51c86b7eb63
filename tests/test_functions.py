import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veriscope.functions import enrich as E
from veriscope.functions import text as X


def values(spark, rows, f, kind="string"):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in d.select(f(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_normalise_url(spark):
    got = values(spark, [
        "https://example.com/a#part", "https://example.com/a?utm_source=x&foo=bar&UTM_MEDIUM=y", "", "   ", None, "HTTP://Example.com", "//example.com/x;v=1",
        "https://e.com/p?a=1&b=&a=2&b=3", "https://e.com/p?q=a%20b&r=~*", "example.com/x", "mailto:a@b.c",
    ], X.normalise_url)
    assert got == [
        "https://example.com/a", "https://example.com/a?foo=bar", "", "", "", "http://Example.com/", "https://example.com/x",
        "https://e.com/p?a=1&a=2&b=3", "https://e.com/p?q=a+b&r=~%2A", "https:example.com/x", "mailto:a@b.c",
    ]


def test_words_urls_mentions(spark):
    texts = ["", None, "a b\tc\x1fd", "see http://x.y", "http:// ", "me@x.org", "# no", "#Öl"]
    assert values(spark, texts, X.word_count) == [0, 0, 4, 2, 1, 1, 2, 1]
    assert values(spark, texts, X.has_urls) == [False, False, False, True, False, False, False, False]
    assert values(spark, texts, X.has_mentions) == [False, False, False, False, False, True, False, True]


def test_tokens(spark):
    assert values(spark, ["The CATS, http://x @me #a ab (dogs) 日本語の"], X.tokens) == [["cats", "@me", "#a", "dogs", "日本語の"]]


def test_hashes_and_unwrap(spark):
    assert values(spark, [None, "u1"], X.sender_hash) == [hashlib.sha256(x.encode()).hexdigest()[:16] for x in ("anonymous", "u1")]
    assert values(spark, [" a \n b "], X.content_hash) == [hashlib.sha256(b"a b").hexdigest()]
    assert values(spark, ["['it\\'s']", '["x"]', " y ", None, "['"], X.unwrap_list) == ["it's", "x", "y", None, "['"]
    assert values(spark, ["<p>a</p>\n<b>c"], X.strip_html) == ["a c"]


@pytest.mark.parametrize("score, level", [(0.39, "LOW"), (0.4, "MEDIUM"), (0.7, "MEDIUM"), (0.71, "HIGH"), (1.0, "HIGH")])
def test_level_bounds(spark, score, level):
    assert values(spark, [score], E.level_of, "double") == [level]


def test_scores(spark):
    maps = [{"toxicity": 0.2, "insult": 0.6, "error": 1.0}, {"fallback": 1.0, "toxicity": 0.5}, {}, None]
    assert values(spark, maps, E.max_score, "map<string,double>") == [0.6, 0.5, None, None]
    assert values(spark, maps, E.analyser_score, "map<string,double>") == [0.5, 0.5, 0.5, 0.5]


def test_detection(spark):
    rows = [("k", False, {"toxicity": 0.1}), ("k", None, {"lexicon_match": 1.0}), (None, True, None), ("", False, {"toxicity": 0.3}), (None, None, None), ("k", True, None)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, matched_keyword string, context_flag boolean, scores map<string,double>")
    got = [(r[0], r[1]) for r in E.detection_fields(d).orderBy("i").select("detection_method", "confidence_score").collect()]
    assert got == [("combined", 1.0), ("lexicon", 1.0), ("gemini", 0.9), ("detoxify", 0.3), ("unknown", 0.0), ("combined", 1.0)]


def test_time_and_place(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 6, 23), " Here "), (datetime(2024, 1, 8), "nowhere")], "timestamp timestamp, county string")
    dim = spark.createDataFrame([("Here", "North", True)], "county string, region string, is_urban boolean")
    got = E.geo_enrich(E.temporal_fields(d), dim).orderBy("timestamp").collect()
    assert [(r["hour_of_day"], r["day_of_week"], r["is_weekend"], r["region"], r["is_urban"]) for r in got] == [(23, "Saturday", True, "North", True), (0, "Monday", False, "Unknown", False)]
