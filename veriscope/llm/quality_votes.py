"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation finds how far each can be trusted.

Only DataFrame functions. One pass over the texts writes a narrow table of counts and votes; EM then works on
the distinct vote patterns (at most 3 ** len(RULES) rows however large the corpus is), and the posterior of each
pattern goes back to its documents.

Defined results: a null or empty text has no words, so all counts are 0 and base_failed is true; repeated rows
and repeated ids are scored one by one; an empty table gives an empty result; extra columns are ignored by
``score_quality`` and kept by ``filter_quality``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import SPACE_CLASS, fresh, let, table, words_of, written

#: Window of the repetition rule, and the two base limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: EM rounds; the weight, in documents, of what is believed before any data speak; the first share of good ones.
ROUNDS, PRIOR_DOCS, GOOD = 15, 10.0, 0.8
#: A document stays if its posterior is at least this.
KEEP_FROM = 0.5

#: (name, votes bad, votes good) over the counts; neither: the rule abstains.
RULES = [
    ("length", "n_words < 20", "n_words >= 50"),
    ("repetition", "100 * n_repeat_words > 15 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words", "100 * n_symbols <= 5 * n_words"),
    ("marks", "100 * n_symbols > 5 * word_chars", "100 * n_symbols <= word_chars"),
    ("lines", "10 * n_dup_lines > 3 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    ("sentences", "60 * n_stops < n_words", "30 * n_stops >= n_words"),
]
#: Before any data speak, a rule that objects says more than one that passes: chances of (bad, abstain, good) by class.
BELIEF = {1: (0.05, 0.10, 0.85), 0: (0.35, 0.15, 0.50)}


def _window_hashes(words) -> F.Column:
    """A 64-bit hash of each window of WINDOW words, in order; null for texts with fewer words."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])))


def _repeat_words(words, hashes) -> F.Column:
    """Words inside windows of WINDOW words that occur at least twice in the text, the first occurrence included.

    A 64-bit hash of each window settles the usual case, no repetition, without building strings (equal windows have
    equal hashes); texts with equal hashes are then counted on the windows themselves.
    """

    def twice(sorted_rows):
        """Of rows (key, i) in order, those whose key a neighbour shares."""
        same = lambda j, k: F.coalesce(F.get(sorted_rows, j)["key"] == F.get(sorted_rows, k)["key"], F.lit(False))
        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(sorted_rows) - 1), lambda j: F.when(same(j, j - 1) | same(j, j + 1), F.get(sorted_rows, j))))

    def covered(rows):
        """Words under the windows of rows, each counted once."""
        at = F.sort_array(F.transform(rows, lambda r: r["i"]))
        steps = lambda p: F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), F.lit(WINDOW), lambda acc, j: acc + F.coalesce(F.least(F.lit(WINDOW), F.get(p, j) - F.get(p, j - 1)), F.lit(0)))
        return F.when(F.size(rows) == 0, F.lit(0)).otherwise(let(at, steps))

    def exact(h):
        hashed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("i"))))
        texts = lambda rows: F.sort_array(F.transform(rows, lambda r: F.struct(F.concat_ws(" ", F.slice(words, r["i"] + 1, WINDOW)).alias("key"), r["i"].alias("i"))))
        return let(let(let(hashed, twice), texts), lambda rows: F.when(F.size(rows) == 0, F.lit(0)).otherwise(let(twice(rows), covered)))

    alone = hashes.isNull() | (F.size(F.array_distinct(hashes)) == F.size(hashes))
    return F.when(alone, F.lit(0)).otherwise(exact(hashes)).cast("long")


def _count_of(text, chars: str) -> F.Column:
    """How many characters of text are among chars."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.when(text.rlike("[" + "".join("\\" + c for c in chars) + "]"), F.length(text) - F.length(rest)).otherwise(F.lit(0)).cast("long")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules look at; columns of docs with the same names are replaced."""
    words, lines, hashes = fresh(docs, "_words"), fresh(docs, "_lines"), fresh(docs, "_hashes")
    t = F.coalesce(F.col(text), F.lit(""))
    lined = docs.withColumns({words: words_of(F.col(text)), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    w, h = F.col(words), F.col(hashes)
    return lined.withColumn(hashes, _window_hashes(w)).withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": _count_of(t, "#*$%&|<>"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_stops": _count_of(t, ".!?"),
            "n_repeat_words": _repeat_words(w, h),
        }
    ).drop(words, lines, hashes)


def with_votes(counted: DataFrame) -> DataFrame:
    """base_failed, and vote_<rule>: 1 good, -1 bad, 0 abstains. Documents that fail the base rules do not vote."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    votes = {f"vote_{name}": F.when(F.expr(bad), F.lit(-1)).when(F.expr(good), F.lit(1)).otherwise(F.lit(0)) for name, bad, good in RULES}
    return counted.withColumns(votes | {"base_failed": failed})


def _votes_one_hot() -> F.Column:
    """1.0, then for each rule whether it said bad, nothing or good."""
    return F.array(F.lit(1.0), *[(F.col(f"vote_{name}") == v).cast("double") for name, _, _ in RULES for v in (-1, 0, 1)])


def fit_accuracies(voted: DataFrame) -> dict:
    """EM over the distinct vote patterns of the documents that passed the base rules.

    Returns the prior of good and, for each class, the chances of (bad, abstain, good) by rule. The driver holds these
    few numbers alone; every round is one aggregate over the pattern table.
    """
    cols = [f"vote_{name}" for name, _, _ in RULES]
    patterns = voted.where(~F.col("base_failed")).groupBy(*cols).agg(F.count("*").cast("double").alias("n"))
    patterns = written(patterns.select("n", _votes_one_hot().alias("x")).coalesce(1), "vote-patterns")
    model = {"good": GOOD, "vote": {y: [BELIEF[y]] * len(RULES) for y in (0, 1)}}
    for _ in range(ROUNDS):
        rows = patterns.withColumn("p", _posterior(model, F.col("x"))).select("n", "p", F.posexplode("x").alias("k", "v"))
        by = {r["k"]: (r["bad"], r["good"]) for r in rows.groupBy("k").agg(F.sum(F.expr("n * (1 - p) * v")).alias("bad"), F.sum(F.expr("n * p * v")).alias("good")).collect()}
        if not by:
            break
        vote = {y: [[by[1 + 3 * r + v][y] + PRIOR_DOCS * BELIEF[y][v] for v in range(3)] for r in range(len(RULES))] for y in (0, 1)}
        model = {"good": (by[0][1] + PRIOR_DOCS * GOOD) / (sum(by[0]) + PRIOR_DOCS), "vote": {y: [[x / sum(r) for x in r] for r in vote[y]] for y in (0, 1)}}
    return model


def _posterior(model: dict, one_hot) -> F.Column:
    """Probability that a document with these votes is good."""
    gains = [math.log(model["good"] / (1 - model["good"]))] + [math.log(g / b) for good, bad in zip(model["vote"][1], model["vote"][0]) for g, b in zip(good, bad)]
    odds = F.aggregate(F.zip_with(one_hot, F.lit(gains), lambda v, g: v * g), F.lit(0.0), lambda acc, v: acc + v)
    return 1 / (1 + F.exp(-odds))


def score_quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, counts, votes, base_failed, p_good (posterior), kept."""
    d = docs.select(F.col(id_col), F.col(text).alias("text") if text != id_col else F.col(text))
    voted = written(with_votes(with_counts(d)).drop("text"), "quality-votes")
    return _judged(voted, fit_accuracies(voted))


def _judged(voted: DataFrame, model: dict) -> DataFrame:
    q = voted.withColumn("p_good", _posterior(model, _votes_one_hot()))
    return q.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM))


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass the base rules and the posterior, with the columns they came with."""
    packed, t = fresh(docs, "_row"), F.col(text)
    own = docs.select(F.struct(*docs.columns).alias(packed), t.alias("text"))
    voted = written(with_votes(with_counts(own)).drop("text"), "quality-votes")
    return _judged(voted, fit_accuracies(voted)).where("kept").select(f"{packed}.*")


def op5_quality_rules(spark, sf_dir):
    s = score_quality(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
