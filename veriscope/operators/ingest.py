"""Candidates from feeds and pages: relevance, deduplication, decisions and their audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions import text as X
from veriscope.operators.classify import classify
from veriscope.sources.keystore import KeyStore
from veriscope.sources.scratch import landed


def domain_allow(df: DataFrame, domains, url: str = "url") -> DataFrame:
    """Rows whose url has an allowed host: a list of hosts, or a table of them (first column) of any size."""
    if isinstance(domains, DataFrame):
        hosts = domains.select(F.lower(domains.columns[0]).alias("_host"))
        return df.join(hosts, X.url_host(F.col(url)) == F.col("_host"), "left_semi")
    return df.where(X.url_host(F.col(url)).isin(*[d.lower() for d in domains]))


def relevant(text, keywords):
    """Whether a text contains any keyword, whatever the case; no keywords: every text is."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k)) if keywords else F.lit(True)


def relevance_filter(df: DataFrame, keywords, text: str = "text") -> DataFrame:
    return df.where(relevant(F.col(text), keywords))


def union_candidates(feeds: DataFrame, pages: DataFrame) -> DataFrame:
    return feeds.unionByName(pages, allowMissingColumns=True)


#: What a store's keys begin with, by kind.
KINDS = {"source_url": "u:", "content_hash": "c:"}


def store_keys(df: DataFrame, kinds=tuple(KINDS)) -> DataFrame:
    """key: the urls and content hashes of rows as a store of keys holds them; empty and null ones are none."""
    named = [F.concat(F.lit(KINDS[k]), F.nullif(k, F.lit(""))) for k in kinds]
    return df.select(F.explode(F.array_compact(F.array(*named))).alias("key"))


def stored_keys(keys: DataFrame, stored, kinds=tuple(KINDS)) -> DataFrame:
    """Those of the keys (distinct) that are stored: stored is a KeyStore, whose filters and buckets are used, or a table
    with the columns of kinds, which is read once and stays where it is while the keys are few enough to be broadcast."""
    if isinstance(stored, KeyStore):
        return stored.stored(keys)
    return store_keys(stored, kinds).join(keys, "key", "left_semi").distinct()


def dedupe(candidates: DataFrame, stored, key: str, within_batch: bool = False) -> DataFrame:
    """Candidates whose key is not stored (a table, or a KeyStore); within_batch also keeps one of those that share a key."""
    if isinstance(stored, KeyStore):
        found = stored.stored(store_keys(candidates, [key]).distinct()).select(F.substring("key", 3, 2**31 - 1).alias(key))
    else:
        found = stored.select(key)
    out = candidates.join(found, key, "left_anti")
    return out.dropDuplicates([key]) if within_batch else out


def prepare(candidates: DataFrame) -> DataFrame:
    """Canonical url, text and content hash; candidates without url or text go."""
    t, s = F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit(""))
    # as the canonical url and the text would tell, but before either is made
    filled = (F.trim(F.coalesce("url", F.lit(""))) != "") & F.when(t != "", F.concat(t, s).rlike(X.NO_SPACE)).otherwise(F.trim(F.substring(s, 1, X.MAX_CHARS)) != "")
    c = candidates.where(filled).withColumns({"source_url": X.normalise_url(F.col("url")), "text": X.candidate_text(F.col("title"), F.col("snippet"))})
    return c.withColumn("content_hash", X.content_hash(F.col("text")))


def _flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with _url and _content: whether their keys are among the found ones."""
    for kind, flag in (("source_url", "_url"), ("content_hash", "_content")):
        own = found.where(F.col("key").startswith(KINDS[kind])).select(F.substring("key", 3, 2**31 - 1).alias("_key"), F.lit(True).alias(flag))
        rows = rows.join(own, F.col(kind) == F.col("_key"), "left").drop("_key").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return rows


def _action(ok):
    return F.when(F.col("_url") | F.col("_content"), "duplicate_skipped").when(~ok, "filter_skipped").otherwise("verified")


def decide(candidates: DataFrame, stored, keywords=()) -> DataFrame:
    """Prepared candidates with action and reason; a url duplicate comes before a content duplicate before relevance.
    The candidates' keys, landed once, meet the store (a table or a KeyStore); only stored keys come back to the rows."""
    keys = landed(store_keys(candidates).distinct(), "candidate-keys")
    c = _flagged(candidates, landed(stored_keys(keys, stored), "stored-keys"))
    ok = relevant(F.col("text"), list(keywords))
    reason = F.when(F.col("_url"), "url").when(F.col("_content"), "content_hash").when(~ok, "no keyword")
    return c.withColumns({"action": _action(ok), "reason": reason}).drop("_url", "_content")


def outcome_counts(candidates: DataFrame, stored, keywords=()) -> DataFrame:
    """counters() of what decide() would say, from the candidates' keys and relevance alone; no text is held or moved."""
    narrow = landed(candidates.select("source_url", "content_hash", relevant(F.col("text"), list(keywords)).alias("_ok")), "candidate-keys")
    found = landed(stored_keys(store_keys(narrow).distinct(), stored), "stored-keys")
    return counters(_flagged(narrow, found).select(_action(F.col("_ok")).alias("action")))


def audit(decided: DataFrame, job_id: str, as_of) -> DataFrame:
    risk = F.col("risk_level") if "risk_level" in decided.columns else F.lit(None).cast("string")
    return decided.select(F.lit(as_of).cast("timestamp").alias("timestamp"), F.lit(job_id).alias("job_id"), "action", "source_type", F.col("source_url").alias("url"), "reason", risk.alias("risk_level"))


def counters(decided: DataFrame) -> DataFrame:
    """Rows by outcome, and all of them as fetched."""
    return decided.rollup("action").agg(F.count("*").alias("n")).select(F.coalesce("action", F.lit("fetched")).alias("outcome"), "n")


def run_cycle(candidates: DataFrame, stored: DataFrame, lexicon: DataFrame, keywords=(), scorer=None) -> DataFrame:
    """One ingestion: decided candidates, those verified with their risk. Feeds the report and the audit sinks."""
    d = decide(prepare(candidates), stored, keywords).withColumns({"scores": F.lit(None).cast("map<string,double>"), "context_flag": F.lit(False)})
    done = classify(d.where("action = 'verified'"), lexicon, scorer)
    return done.unionByName(d.where("action <> 'verified'"), allowMissingColumns=True)
