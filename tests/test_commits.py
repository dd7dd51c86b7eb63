"""Committed batches: failures between writes, replays, compaction; ingestion over them."""

import json
import os

import pytest

from veriscope.operators import ingest as I
from veriscope.sources.commits import CommitLog
from veriscope.sources.keystore import KeyStore
from veriscope.streaming import jobs

S = "x int"


def table(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], S)


def seen(log, name="a"):
    return sorted(r["x"] for r in log.read(name, S).collect())


def test_only_whole_batches_are_seen(spark, tmp_path, monkeypatch):
    log = CommitLog(spark, str(tmp_path))
    assert seen(log) == [] and not log.has(0)
    assert log.write(0, {"a": table(spark, 1, 2), "b": table(spark, 7)})
    # fails between the two tables of a batch
    stage = CommitLog.stage
    monkeypatch.setattr(CommitLog, "stage", lambda self, n, t, d: stage(self, n, t, d) if t == "a" else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.write(1, {"a": table(spark, 3), "b": table(spark, 8)})
    monkeypatch.setattr(CommitLog, "stage", stage)
    assert seen(log) == [1, 2] and seen(log, "b") == [7] and not log.has(1)
    # fails between the tables and the commit
    publish = CommitLog._publish
    monkeypatch.setattr(CommitLog, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.write(1, {"a": table(spark, 3), "b": table(spark, 8)})
    monkeypatch.setattr(CommitLog, "_publish", publish)
    assert seen(log) == [1, 2]
    assert log.write(1, {"a": table(spark, 3), "b": table(spark, 8)}) and not log.write(1, {"a": table(spark, 99)})
    assert seen(log) == [1, 2, 3] and seen(log, "b") == [7, 8]


def test_compaction(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    for n in range(4):
        log.write(n, {"a": table(spark, n)})
    held = log.read("a", S)
    assert log.compact({"a": S}, files=1) and not log.compact({"a": S})
    assert seen(log) == [0, 1, 2, 3] == sorted(r["x"] for r in held.collect()) and log.has(2) and not log.write(3, {"a": table(spark, 9)})
    log.write(4, {"a": table(spark, 4)})
    assert log.clean() == 4 and seen(log) == [0, 1, 2, 3, 4] and len(os.listdir(tmp_path / "data/a")) == 2
    names = [n for n in os.listdir(tmp_path / "commits") if n.endswith(".json")]
    assert sorted(names) == ["000000000004.json", "upto-000000000003.json"] and json.loads((tmp_path / "commits/upto-000000000003.json").read_text())["upto"] == 3


@pytest.fixture()
def lexicon(spark):
    return spark.createDataFrame([(1, "bad", "HIGH", None)], "priority int, term string, risk_level string, context string")


C = "url string, title string, snippet string, source_type string"


def land(spark, path, *names):
    spark.createDataFrame([(f"https://e.com/{n}", "T", f"text {n}", "rss") for n in names], C).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, tmp_path, lexicon):
    stream = spark.readStream.schema(C).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.start_ingest(stream, str(tmp_path / "store"), lexicon, str(tmp_path / "check")).awaitTermination()
    log = CommitLog(spark, str(tmp_path / "store"))
    reports = sorted(r["source_url"][-1] for r in log.read("reports", jobs.STORED).collect())
    audit = sorted((r["url"][-1], r["action"]) for r in log.read("audit", "url string, action string").collect())
    return reports, audit


@pytest.mark.parametrize("where", ["between the tables", "before the commit", "before the keys"])
def test_ingestion_replays(spark, tmp_path, lexicon, monkeypatch, where):
    land(spark, str(tmp_path / "in"), "1", "2")
    ingest(spark, tmp_path, lexicon)
    land(spark, str(tmp_path / "in"), "2", "3")
    with monkeypatch.context() as m:
        stage = CommitLog.stage
        if where == "between the tables":
            m.setattr(CommitLog, "stage", lambda self, n, t, d: stage(self, n, t, d) if t == "reports" else 1 / 0)
        elif where == "before the commit":
            m.setattr(CommitLog, "_publish", lambda *a: 1 / 0)
        else:
            m.setattr(KeyStore, "add", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            ingest(spark, tmp_path, lexicon)
    want = ["1", "2", "3"], [("1", "verified"), ("2", "duplicate_skipped"), ("2", "verified"), ("3", "verified")]
    assert ingest(spark, tmp_path, lexicon) == want  # the batch runs again
    land(spark, str(tmp_path / "in"), "3", "1")
    reports, audit = ingest(spark, tmp_path, lexicon)
    assert reports == ["1", "2", "3"] and len(audit) == 6 and audit.count(("3", "duplicate_skipped")) == 1


def test_decisions_by_filters_and_by_table(spark, tmp_path, lexicon):
    c = spark.createDataFrame([(f"https://e.com/{i}", "T", f"the {i % 40}", "rss") for i in range(60)] + [("", "T", "x", "rss"), (None, None, None, "rss"), ("https://e.com/x", "", "  ", "rss"), ("https://e.com/y", " ", " ", "rss")], C)
    p = I.prepare(c)
    assert p.count() == 60
    stored = p.where("source_url like '%/1_'").select("source_url", "content_hash")
    store = KeyStore.create(spark, str(tmp_path / "k"), buckets=3)
    store.add(I.store_keys(stored))
    both = [sorted(map(str, I.decide(p, s, ["THE"]).select("source_url", "action", "reason").collect())) for s in (stored, store)]
    assert both[0] == both[1] and len(both[0]) == 60
    counts = [sorted(map(tuple, I.outcome_counts(p, s, ["THE 1"]).collect())) for s in (stored, store)]
    assert counts[0] == counts[1] == sorted(map(tuple, I.counters(I.decide(p, stored, ["THE 1"])).collect()))
    assert [I.dedupe(p, s, "content_hash", True).count() for s in (stored, store)] == [30, 30]
