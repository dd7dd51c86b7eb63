import time

import pytest

pytest.importorskip("veriscope.llm")
import corpus_pipeline  # noqa: E402
from veriscope.llm.common import written  # noqa: E402

from .test_operators import documents, prose  # noqa: E402


def test_stages_take_effect(spark, small):
    copy = prose(1, 120)
    texts = [copy, copy + " end", "too short", prose(2, 8), prose(3, 100) + ' token = "abcdef123456"', *[prose(i, 100) for i in range(10, 60)], *[prose(i, 100).replace(" ", "### ") for i in range(60, 70)]]
    d = documents(spark, texts)
    seen = [d]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], small), name))
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert {2, 3} & ids[1] == set() and {0, 1, 4} <= ids[1] and max(ids[1]) == 54 and 1 not in ids[2] and 0 in ids[2]
    assert all(x.columns == d.columns for x in seen[:-1])
    clean = seen[3].where("doc_id = 4").first()
    assert "abcdef123456" not in clean["text"] and clean["n_chars"] == len(clean["text"]) and ids[3] == ids[2]
    words = lambda x: sum(len(r["text"].split()) for r in x.collect())
    assert abs(words(seen[4]) / words(seen[3]) - 1.5) < 0.1
    assert seen[5].count() == seen[4].count() and {"doc_id", "n_tokens", "ids"} <= set(seen[5].columns)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


def odd(spark):
    rows = [(0, None, "en", "s0", 0), (1, "", "en", None, 0), (2, " \n ", None, "s1", 3), (None, prose(4, 60), "en", "s0", 1), (4, prose(5, 60), "en", "s0", 1), (4, prose(5, 60), "en", "s0", 1), (5, "word " * 60_000, "en", "s1", 1), (6, prose(6, 60) + " token = 'abcdef123'", "en", "s1", 1), *[(i, prose(i, 60), "en", f"s{i % 2}", 1) for i in range(10, 30)]]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.selectExpr("*", "'kept' as row", "1 as copies", "'x' as _n", "0 as component_id")


def test_every_stage_takes_odd_tables(spark, small):
    d = odd(spark)
    whole = d.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, small)
        rows = got.collect()
        if name != "byte_bpe":
            assert got.columns == d.columns, name
            assert {r["row"] for r in rows} <= {"kept"} and len(rows) > 0
        if name == "quality_rules":
            assert {0, 1, 2, 5}.isdisjoint({r["doc_id"] for r in rows})
        elif name == "shingle_join":
            assert {r["doc_id"] for r in rows} >= {0, 1, 2, 5, 6, *range(10, 30)}
        elif name == "secret_crf":
            assert len(rows) == whole and {r["doc_id"]: r["text"] for r in rows}[0] is None and "abcdef123" not in {r["doc_id"]: r["text"] for r in rows}[6]
        elif name == "source_mix":
            assert {5, 6} & {r["doc_id"] for r in rows}
        else:
            by = {r["doc_id"]: r for r in rows}
            assert len(rows) == whole and by[0]["n_tokens"] == by[1]["n_tokens"] == 0 and by[5]["text"] == "word " * 60_000
        none = stage(spark, d.limit(0), small)
        assert none.count() == 0 and none.columns == got.columns


def test_written_leaves_no_shuffle_files(spark):
    from pyspark.sql import functions as F

    from veriscope.llm.common import written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before, held = files(), spark.conf.get(key)
    out = written(spark.range(1000).repartition(5).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "shuffled")
    for _ in range(50):  # the files go shortly after the write
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and spark.conf.get(key) == held
    assert sum(r["n"] for r in out.collect()) == 1000
