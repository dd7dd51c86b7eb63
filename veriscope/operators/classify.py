"""Lexicon matching and risk classification of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veriscope.functions import enrich as E


def lexicon_array(lexicon: DataFrame):
    """The lexicon as a literal array in order: HIGH terms by priority, then MEDIUM. A lexicon is a list kept by hand
    (a few thousand terms); LEXICON_ROWS bounds what is brought here."""
    rows = lexicon.where(F.col("risk_level").isin("HIGH", "MEDIUM")).orderBy(F.col("risk_level") != "HIGH", "priority").select("term", "risk_level").limit(LEXICON_ROWS + 1).collect()
    if len(rows) > LEXICON_ROWS:
        raise ValueError(f"a lexicon has {LEXICON_ROWS} terms at most; use lexicon_match_large")
    if not rows:
        return F.array().cast("array<struct<term:string,risk_level:string>>")
    return F.array(*[F.struct(F.lit(r["term"]).alias("term"), F.lit(r["risk_level"]).alias("risk_level")) for r in rows])


LEXICON_ROWS = 5000


def has_term(text, term, word_boundary: bool):
    return F.regexp_like(text, F.concat(F.lit(r"(?U)\b\Q"), F.lower(term), F.lit(r"\E\b"))) if word_boundary else F.contains(text, F.lower(term))


def lexicon_match(df: DataFrame, lexicon: DataFrame, text: str = "text", word_boundary: bool = False) -> DataFrame:
    """df with matched_term and lexicon_level: the first term, HIGH ones first, that the lower-cased text contains."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hit = F.get(F.filter(lexicon_array(lexicon), lambda x: has_term(t, x["term"], word_boundary)), F.lit(0))
    return df.withColumn("_hit", hit).withColumns({"matched_term": F.col("_hit")["term"], "lexicon_level": F.col("_hit")["risk_level"]}).drop("_hit")


def lexicon_match_join(df: DataFrame, lexicon: DataFrame, text: str = "text", word_boundary: bool = False) -> DataFrame:
    """lexicon_match by joins alone, for a lexicon of any size (see ``automaton.lexicon_match_large``, which chooses)."""
    from veriscope.operators.automaton import match_by_grams, ranked_terms

    return match_by_grams(df, ranked_terms(lexicon), text, word_boundary)


def keyword_context(df: DataFrame, lexicon: DataFrame, keyword: str = "matched_term") -> DataFrame:
    """df with the sentence that explains its keyword; of a term listed more than once, that of least priority which has
    one. The lexicon is used whole; Spark chooses the join by its size."""
    c = lexicon.where("context is not null").groupBy(F.lower("term").alias("_term")).agg(F.min(F.struct("priority", "context")).getField("context").alias("_context"))
    return df.join(c, F.lower(F.col(keyword)) == F.col("_term"), "left").withColumn("keyword_context", F.coalesce("_context", F.lit(E.DEFAULT_CONTEXT))).drop("_term", "_context")


def response_messages(df: DataFrame, risk: str = "risk_level", keyword: str | None = None, templates: dict | None = None) -> DataFrame:
    """df with messages, a struct by language; a HIGH message with a keyword also has the keyword's context (column
    keyword_context, if present)."""
    templates = templates or E.MESSAGES
    r = F.col(risk)

    def said(by):
        high = F.lit(by["HIGH"])
        if keyword and "keyword_context" in df.columns:
            high = F.when(F.col(keyword).isNotNull(), F.concat(F.lit(by["HIGH"] + " "), F.col("keyword_context"))).otherwise(high)
        return F.when(r == "HIGH", high).when(r == "MEDIUM", by["MEDIUM"]).otherwise(by["LOW"])

    return df.withColumn("messages", F.struct(*[said(templates.get(lang, templates["english"])).alias(lang) for lang in ("english", "swahili", "sheng")]))


def classify(df: DataFrame, lexicon: DataFrame, scorer=None, context=None, max_length: int | None = None) -> DataFrame:
    """df (text, scores, context_flag) with matched_keyword, scores, risk_level, explanation.

    A HIGH term settles a message, with scores {lexicon_match: 1.0}. Otherwise the scores decide, a context flag
    lifts to HIGH, a MEDIUM term lifts LOW to MEDIUM. scorer and context are optional pandas functions (see
    ``score_with``); they run on the messages that no HIGH term has settled, and add score_outcome, context_outcome and
    context_reason (null for settled ones). With max_length, messages without text or with a longer one are left out;
    ``outside_length`` has them.
    """
    if max_length is not None:
        df = df.where(_within(max_length))
    m = lexicon_match(df, lexicon)
    settled = F.coalesce(F.col("lexicon_level") == "HIGH", F.lit(False))
    if scorer or context:
        m = m.where(settled).unionByName(score_with(m.where(~settled), scorer, context), allowMissingColumns=True)
    scores = F.when(settled, F.create_map(F.lit("lexicon_match"), F.lit(1.0))).otherwise(F.col("scores"))
    flag = F.coalesce("context_flag", F.lit(False)) & ~settled
    by_score = E.level_of(E.analyser_score(F.col("scores")))
    risk = F.when(settled | flag, "HIGH").when((F.col("lexicon_level") == "MEDIUM") & (by_score == "LOW"), "MEDIUM").otherwise(by_score)
    out = m.withColumns({"risk_level": risk, "scores": scores, "context_flag": flag, "matched_keyword": F.col("matched_term")})
    why = E.explanation(F.col("risk_level"), F.col("matched_keyword"), F.col("context_flag"), F.element_at("scores", "toxicity"))
    return out.withColumn("explanation", why).drop("matched_term", "lexicon_level")


#: Code points of a message that is taken for verification.
MESSAGE_LENGTH = 5000


def _within(most: int):
    return F.coalesce(F.length("text").between(1, most), F.lit(False))


def outside_length(df: DataFrame, most: int = MESSAGE_LENGTH) -> DataFrame:
    """Messages without text, or with more than so many code points, with the reason."""
    return df.where(~_within(most)).withColumn("reason", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "empty text").otherwise("text too long"))


class ModelUnavailable(Exception):
    """Raised by a scorer that has no model: its messages get the fallback scores."""


def outcomes_of(f, texts: list, fallback, failed) -> list[tuple]:
    """(value, outcome) for each text. f takes all texts at once; where it fails, each text is tried alone, so that one bad
    text costs its own result and no other. Outcomes: ok, fallback (no model), error."""
    try:
        got = list(f(texts))
        if len(got) != len(texts):
            raise ValueError("one result for each text is needed")
        return [(x, "ok") for x in got]
    except ModelUnavailable:
        return [(fallback, "fallback")] * len(texts)
    except Exception:  # a model's failure is a result, not the job's
        return [(failed, "error")] if len(texts) == 1 else [x for t in texts for x in outcomes_of(f, [t], fallback, failed)]


def score_with(df: DataFrame, scorer=None, context=None) -> DataFrame:
    """df with scores and context_flag from user functions, loaded once for each Python worker's partition, and what
    came of them: score_outcome, context_outcome (ok, fallback, error; null without that function) and context_reason.

    scorer takes texts and gives a map of scores each; without a model (``ModelUnavailable``) a message has {toxicity:
    0.5, fallback: 1.0}, after an error {toxicity: 0.5, error: 1.0}. context takes texts and gives for each whether it is
    flagged, or (flagged, reason); without a model or after an error nothing is flagged and there is no reason.
    """

    def run(batches):
        for b in batches:
            texts = b["text"].fillna("").tolist()
            b["score_outcome"], b["context_outcome"], b["context_reason"] = None, None, None
            if scorer and len(b):
                got = outcomes_of(scorer, texts, {"toxicity": 0.5, "fallback": 1.0}, {"toxicity": 0.5, "error": 1.0})
                b["scores"], b["score_outcome"] = [{k: float(v) for k, v in x.items()} for x, _ in got], [o for _, o in got]
            if context and len(b):
                got = [(x if isinstance(x, tuple) else (x, ""), o) for x, o in outcomes_of(context, texts, (False, ""), (False, ""))]
                b["context_flag"], b["context_reason"], b["context_outcome"] = [bool(x[0]) for x, _ in got], [x[1] or None for x, _ in got], [o for _, o in got]
            yield b

    schema = StructType([*df.schema.fields, *(StructField(n, StringType()) for n in ("score_outcome", "context_outcome", "context_reason"))])
    return df.mapInPandas(run, schema)
