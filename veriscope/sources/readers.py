"""Readers: feeds, web pages, labelled texts, lexicon files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriscope.functions import text as X
from veriscope.operators.ingest import domain_allow
from veriscope.schema import LEXICON

#: Names under which the text and the county are looked for (fixed values).
TEXT_NAMES = ("tweet", "text", "message", "content", "body", "comment")
COUNTY_NAMES = ("county", "location", "region", "place")

_ITEM = "title string, link string, description string, summary string"
_ENTRY = "title string, link struct<_href:string>, summary string, content string"


def snippet(*parts) -> F.Column:
    """First non-empty part, without tags, white space collapsed, cut."""
    first = F.coalesce(*[F.nullif(p, F.lit("")) for p in parts], F.lit(""))
    return F.substring(X.strip_html(first), 1, X.MAX_CHARS)


def feed_candidates(spark: SparkSession, path: str, feed: str = "", atom: bool = False) -> DataFrame:
    """Candidates of landed feed files (rss items, or atom entries)."""
    rows = spark.read.format("xml").option("rowTag", "entry" if atom else "item").schema(_ENTRY if atom else _ITEM).load(path)
    link, body = (F.col("link._href"), [F.col("summary"), F.col("content")]) if atom else (F.col("link"), [F.col("summary"), F.col("description")])
    url = X.normalise_url(link)
    return rows.where(F.coalesce(link, F.lit("")) != "").select(url.alias("url"), F.coalesce("title", F.lit("")).alias("title"), snippet(*body).alias("snippet"), F.lit("rss").alias("source_type"), F.lit(feed).alias("source_feed"))


def page_candidates(pages: DataFrame, domains) -> DataFrame:
    """Candidates of a table of pages (url, html): allowed hosts, title and the text of what is not boilerplate by tag."""
    html = F.coalesce("html", F.lit(""))
    unescaped = lambda t: _unescape(t)
    title = X.collapse(unescaped(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|nav|header|footer|aside|form|head|title)\b.*?</\1\s*>", " ")
    text = X.collapse(unescaped(F.regexp_replace(body, "<[^>]+>", " ")))
    c = domain_allow(pages, domains).select(X.normalise_url(F.col("url")).alias("url"), title.alias("title"), text.alias("t"))
    joined = F.regexp_replace(F.concat("title", F.lit("\n\n"), "t"), r"^\s+|\s+$", "")
    return c.where("title <> '' or t <> ''").select("url", "title", F.substring(joined, 1, X.MAX_CHARS).alias("snippet"), F.lit("scraped").alias("source_type"))


def _unescape(t):
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return t


def pick(columns, names, default=None, any_case=False):
    by = {c.lower(): c for c in reversed(columns)} if any_case else {c: c for c in columns}
    return next((by[n] for n in names if n in by), default)


def dataset_import(spark: SparkSession, path: str, tabs: bool = False, limit: int | None = None) -> DataFrame:
    """Labelled texts from delimited files: text and county columns by name, list literals unwrapped, empty texts gone."""
    raw = spark.read.csv(path, sep="\t" if tabs else ",", header=True, mode="DROPMALFORMED", multiLine=True, escape='"')
    if limit is not None:
        raw = raw.limit(limit)
    text, county = pick(raw.columns, TEXT_NAMES, raw.columns[0], any_case=True), pick(raw.columns, COUNTY_NAMES)
    place = F.trim(F.col(county)) if county else F.lit(None).cast("string")
    clean = F.when((place != "") & (F.lower(place) != "nan"), place)
    return raw.dropna(subset=[text]).select(X.unwrap_list(F.col(text)).alias("text"), clean.alias("county")).where("length(text) > 0")


def extend_lexicon(lexicon: DataFrame, more: DataFrame) -> DataFrame:
    """The lexicon and those rows of more (term, risk_level_guess) that it lacks at their level, with later priorities."""
    new = more.select(F.trim("term").alias("term"), F.upper(F.trim("risk_level_guess")).alias("risk_level")).where("term <> '' and risk_level in ('HIGH', 'MEDIUM')").distinct()
    new = new.join(lexicon.select("term", "risk_level"), ["term", "risk_level"], "left_anti")
    last = lexicon.agg(F.coalesce(F.max("priority"), F.lit(0)).alias("last"))  # one row
    # numbered inside groups by level and first letters; one window runs over the groups' sizes alone
    group = ["risk_level", "_start"]
    new = new.withColumn("_start", F.left("term", F.lit(3)))
    sizes = new.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("term")) + F.col("_before")
    new = new.join(sizes.withColumn("_before", before).drop("_n"), group).withColumn("_rank", rank)
    new = new.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("_rank")).cast("int").alias("priority"), "term", "risk_level", F.lit(None).cast("string").alias("context"))
    return lexicon.select(*LEXICON.names).unionByName(new)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)
