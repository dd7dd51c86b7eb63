"""The risk model against a direct solve, and on labelled documents it has not seen."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veriscope.operators import risk_model as M
from veriscope.plans import registry

TEXTS = [("good sunny calm day", 0), ("calm river, good day", 0), ("bad angry fight", 1), ("angry bad words", 1), ("good fight", 0), ("bad day", 1), (None, 0), ("", 1), ("calm calm calm", 0), ("angry", 1)]


def test_same_as_a_direct_solve(spark):
    dim = 16
    d = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(TEXTS)], "id long, text string, label int").repartition(3)
    model = M.fit(d, dim=dim, penalty=0.5)
    counts = M.term_counts(d, "id", "text", dim)
    held = {r["id"]: (r["columns"], r["values"]) for r in M.vectors(counts, model.idf).collect()}
    x = M._dense([held.get(i, ([], []))[0] for i in range(len(TEXTS))], [held.get(i, ([], []))[1] for i in range(len(TEXTS))], dim)
    assert np.allclose(np.sort((x[:, :dim] ** 2).sum(1).round(9)), [0, 0] + [1] * 8)
    y, beta, ridge = np.array([y for _, y in TEXTS], float), np.zeros(dim + 1), np.diag([0.5] * dim + [1e-9])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ beta)))
        beta += np.linalg.solve(x.T @ np.diag(p * (1 - p)) @ x + ridge, x.T @ (y - p) - ridge @ beta)
    assert np.allclose(model.beta, beta, atol=1e-7)
    got = {r["id"]: r["custom_risk_score"] for r in model.score(d.withColumn("columns", F.lit(1)), "id").collect()}
    assert np.allclose([got[i] for i in range(len(TEXTS))], 1 / (1 + np.exp(-(x @ beta))), atol=1e-9)


def test_tree_of_sums(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 2)
    parts = spark.createDataFrame([(bytearray(np.array([float(i), 1.0]).tobytes()),) for i in range(9)], "sums binary").repartition(9)
    assert M.tree_sum(parts).tolist() == [36.0, 9.0]


def test_auc_and_levels(spark):
    d = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9), (0, 0.2)], "label int, custom_risk_score double")
    assert abs(M.auc(d).first()["auc"] - (3 + 3 - 0.5) / 6) < 1e-12
    levels = [r[0] for r in spark.createDataFrame([("LOW", 0.1), ("LOW", 0.5), ("LOW", 0.8), ("MEDIUM", 0.1), ("HIGH", 0.0)], "r string, s double").select(M.ensemble(F.col("r"), F.col("s"))).collect()]
    assert levels == ["LOW", "MEDIUM", "HIGH", "MEDIUM", "HIGH"]


def test_held_out_documents(spark):
    import os

    import pytest

    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    got = registry.QUERIES["risk_model"](spark, d)
    assert M.auc(got.where("held_out")).first()["auc"] > 0.7


def test_sums_are_made_in_tasks_of_their_own(spark):
    """However few tasks the sums meet in, those that make them stay as many as there are partitions."""

    def run(batches):
        from pyspark import TaskContext

        list(batches)
        yield pd.DataFrame({"sums": [np.array([2.0 ** TaskContext.get().partitionId()]).tobytes()]})

    assert M.tree_sum(spark.range(0, 12, 1, 12).mapInPandas(run, "sums binary")).tolist() == [2.0**12 - 1]
