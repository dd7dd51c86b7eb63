"""A risk model of one's own: hashed TF-IDF and logistic regression, as one more vote beside lexicon and scores.

Terms are hashed into DIM columns; document frequencies and weights are Spark aggregates. The regression is fitted by
second-order steps: in each, every task adds up gradient and curvature of its rows (DIM squared numbers, whatever
the number of rows), sums meet in a tree, and the driver solves one system of DIM equations. The penalty makes the
solution unique, so it is that of any exact solver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriscope.functions import text as X
from veriscope.sources.scratch import landed

DIM, PENALTY, STEPS, TOLERANCE = 2048, 0.1, 25, 1e-9
#: Sums that meet in one task of the tree: 34 MB each at DIM columns.
FAN = 4
HIGH, MEDIUM = 0.7, 0.4


def term_counts(docs: DataFrame, id_col: str, text: str, dim: int = DIM) -> DataFrame:
    """id, column, tf: hashed terms of each document."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(X.tokens(F.col(text), 2)).alias("term"))
    return words.groupBy("id", F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("column")).agg(F.count("*").alias("tf"))


def inverse_frequencies(counts: DataFrame, documents: int) -> DataFrame:
    """column, idf; dim rows at most."""
    return counts.groupBy("column").agg(F.count("*").alias("df")).select("column", (F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def vectors(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """id, columns, values: (1 + ln tf) idf by document, scaled to length 1; dim entries at most."""
    v = counts.join(F.broadcast(idf), "column").withColumn("v", (1 + F.log("tf")) * F.col("idf"))
    rows = v.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("column", "v"))).alias("x"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    return rows.select("id", F.col("x.column").alias("columns"), F.transform("x.v", lambda v: v / F.col("length")).alias("values"))


def _dense(columns, values, dim: int) -> np.ndarray:
    x = np.zeros((len(columns), dim + 1))
    x[:, dim] = 1.0  # the constant
    for i, (c, v) in enumerate(zip(columns, values)):
        x[i, c] = v
    return x


def _sums(beta: np.ndarray, dim: int):
    """For the batches of a task: gradient, curvature and number of rows, as one row of bytes."""

    def run(batches):
        g, h, n = np.zeros(dim + 1), np.zeros((dim + 1, dim + 1)), 0
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                x, y = _dense(part["columns"], part["values"], dim), part["label"].to_numpy(float)
                p = 1 / (1 + np.exp(-(x @ beta)))
                g += x.T @ (y - p)
                h += (x * (p * (1 - p))[:, None]).T @ x
                n += len(part)
        yield pd.DataFrame({"sums": [np.concatenate([g, h.ravel(), [n]]).tobytes()]})

    return run


def _add(batches):
    total = None
    for b in batches:
        for s in b["sums"]:
            s = np.frombuffer(s)
            total = s.copy() if total is None else total + s
    if total is not None:
        yield pd.DataFrame({"sums": [total.tobytes()]})


def tree_sum(parts: DataFrame) -> np.ndarray:
    """The sum of rows of bytes: FAN of them meet in a task, then FAN of what is left, until one task's are left.

    Sums go through an exchange to where they meet: merged without one, the tasks before would run in as few tasks, and
    one after the other where the last of them are fetched.
    """
    n = parts.rdd.getNumPartitions()
    while True:
        n = -(-n // FAN)
        parts = parts.repartition(n, F.spark_partition_id() % n).mapInPandas(_add, "sums binary")
        if n == 1:
            return sum(np.frombuffer(r["sums"]) for r in parts.toLocalIterator())


@dataclass
class RiskModel:
    beta: np.ndarray  # weights by column, then the constant
    idf: DataFrame
    dim: int

    def score(self, docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
        """docs with custom_risk_score (0 to 1): documents without terms have the score of the constant."""
        weights = docs.sparkSession.createDataFrame([(i, float(b)) for i, b in enumerate(self.beta[: self.dim])], "column int, weight double")
        known = F.broadcast(self.idf.join(weights, "column"))  # dim rows at most
        v = term_counts(docs, id_col, text, self.dim).join(known, "column").withColumn("v", (1 + F.log("tf")) * F.col("idf"))
        scored = v.groupBy(F.col("id").alias("_id")).agg((F.sum(F.col("v") * F.col("weight")) / F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("_z"))
        z = F.coalesce("_z", F.lit(0.0)) + float(self.beta[self.dim])
        return docs.join(scored, F.col(id_col) == F.col("_id"), "left").withColumn("custom_risk_score", 1 / (1 + F.exp(-z))).drop("_id", "_z")


def fit(labelled: DataFrame, id_col: str = "id", text: str = "text", label: str = "label", dim: int = DIM, penalty: float = PENALTY) -> RiskModel:
    """The model of labelled documents (label 0 or 1; one row for each id)."""
    counts = landed(term_counts(labelled, id_col, text, dim), "risk-terms")
    idf = landed(inverse_frequencies(counts, labelled.count()), "risk-idf")
    x = labelled.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("label")).join(vectors(counts, idf), F.col("_id") == F.col("id"), "left")
    rows = landed(x.select("label", F.coalesce("columns", F.array().cast("array<int>")).alias("columns"), F.coalesce("values", F.array().cast("array<double>")).alias("values")), "risk-vectors")
    beta, ridge = np.zeros(dim + 1), np.full(dim + 1, float(penalty))
    ridge[dim] = 1e-9  # the constant is not held back
    for _ in range(STEPS):
        total = tree_sum(rows.mapInPandas(_sums(beta, dim), "sums binary"))
        g, h = total[: dim + 1] - ridge * beta, total[dim + 1 : -1].reshape(dim + 1, dim + 1) + np.diag(ridge)
        step = np.linalg.solve(h, g)
        beta = beta + step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < TOLERANCE:
            break
    return RiskModel(beta, idf, dim)


def ensemble(risk: Column, score: Column) -> Column:
    """HIGH if either says so; MEDIUM instead of LOW where the model sees a middling risk."""
    return F.when((risk == "HIGH") | (score > HIGH), "HIGH").when((risk == "LOW") & (score >= MEDIUM), "MEDIUM").otherwise(risk)


def auc(scored: DataFrame, label: str = "label", score: str = "custom_risk_score", digits: int = 5) -> DataFrame:
    """One row (auc): how often a row of label 1 scores above one of label 0, ties counting half; scores are rounded, so
    that one window runs over a bounded number of steps."""
    steps = scored.groupBy(F.round(score, digits).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = steps.withColumn("below", below)
    return s.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))
