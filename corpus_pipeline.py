"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, tokens.

Each stage takes all documents that the one before kept. The first four return the columns of documents; the last
returns each document of the mix with its tokens.

Defined results: null, empty and word-free texts fail the base rules and go in the first stage; where they reach a later
stage by themselves, the near-duplicate stage and the secrets keep them as they are, the mix may take them (they add no
words to it), and they have no tokens. Rows with a null id are documents like others; repeated rows of one id stay or go
together in the near-duplicate stage. An empty table gives an empty one at every stage. Other columns go through the first
four stages, whatever their names; the last keeps doc_id, lang and source. Texts are taken whole.
The stages that call Python workers set the session's batch size (BATCH) where it is unset; it stays set, since
their results are computed later.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veriscope.llm import byte_bpe, quality_votes, secret_crf, shingle_join, source_mix
from veriscope.llm.common import table, written


#: Rows in a batch between the JVM and a Python worker, where the session names none: bounds what both hold of long texts.
BATCH = 2_000


def _batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH)


def quality(spark, docs, sf_dir):
    """Documents that the base rules or the weighed votes reject go."""
    return quality_votes.filter_quality(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document stays of each group of near-duplicates (five-word shingles, similarity 0.8 or more): the smallest id."""
    _batches(spark)
    return shingle_join.one_of_each(docs, n=5, percent=80)


def secrets(spark, docs, sf_dir):
    """Secrets are replaced by a mark; n_chars follows the text."""
    _batches(spark)
    return secret_crf.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark, docs, sf_dir):
    """Documents are taken as often as the mix of sources takes them: left out, once or twice."""
    return source_mix.sample_mix(docs)


def tokens(spark, docs, sf_dir):
    """Token ids of each document, and the text that they decode to: doc_id, lang, source, n_tokens, ids, text."""
    _batches(spark)
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.tokenize(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN, decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [("quality_rules", quality), ("shingle_join", near_duplicates), ("secret_crf", secrets), ("source_mix", mixture), ("byte_bpe", tokens)]

#: SQL cannot express the stages (EM, a trained field, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages, one after the other, over documents; each result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
