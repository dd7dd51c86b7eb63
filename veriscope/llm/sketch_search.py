"""Ranked lexical search over hashed max-sketches.

A document's score for a query sums, over the query's terms, the term's weight times a saturating function of how often
the document has the term, all in whole numbers (see ``weight`` and ``saturation``).

*Index.* One pass counts the corpus: documents, terms, and documents for each term (each task adds up before anything
moves). A second pass writes an index row for each document: its text and its sketch. The sketch has WIDTH
coordinates; a term's coordinate is a hash of it, and a coordinate holds the largest impact (weight times
saturation) of the document's terms there, rounded up to 16 bits. Only coordinates in use are stored. The weights of
the FREQUENT terms found in most documents are exact; any other term is taken to have the weight of a term in one
document, the largest there is. A sketch so bounds from above what any term adds to the document's score.

*Search.* Queries come in blocks of bounded size. Each task looks up all queries of a block in a batch of sketches at
once, which gives an upper bound for every document and query. For each query the documents are taken by descending
bound and scored exactly from the text, until the bound falls below the score of the task's k-th best document. The
tasks' best are merged; nothing else moves. The result is exact.

Defined results: null and term-free texts have no terms and are in no result; a query without terms has no rows;
repeated documents and queries each count; a null id comes last among equal scores; a corpus without terms gives an
empty result; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.llm.common import released, table, written

#: Coordinates of a sketch.
WIDTH = 1 << 14
#: Terms whose exact weight a sketch uses, those in most documents; longer ones than TERM_BYTES are not among them.
FREQUENT, TERM_BYTES = 1 << 16, 48
#: A block of queries ends when it has so many, or so many bytes of text.
BLOCK_QUERIES, BLOCK_BYTES = 1024, 4 << 20
#: A task sends its counts on when it holds so many terms, or so many bytes of them.
HELD_TERMS, HELD_BYTES = 1 << 18, 32 << 20
#: Numbers of a dense batch of sketches.
BATCH_CELLS = 1 << 22
#: Groups in which a query's best documents are merged first.
GROUPS = 32

#: Bytes as terms see them: ASCII letters in lower case, digits and bytes of other characters stay, all else is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    """How long a document of n terms is: 100 for one of average length."""
    return 75 + 25 * n * n_docs // n_terms


def saturation(tf, m):
    """Below 1,000,000, whatever tf."""
    return (1000000000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Index:
    """rows: doc_id, text (binary), n (terms), coordinates and values of the sketch (binary, 16 bits each)."""

    rows: DataFrame
    vocabulary: DataFrame  # term (binary), df
    n_docs: int
    n_terms: int
    unit: int  # a sketch's value times unit is an impact


def count_terms(docs: DataFrame, text: str) -> DataFrame:
    """term (binary), df, total: by term, the documents that have it; the row without a term has the number of documents
    with terms, and of all their terms."""

    @released
    def run(batches):
        df, size, n_docs, n_terms = Counter(), 0, 0, 0

        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([0] * len(counts), pa.int64())], names=["term", "df", "total"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = terms(t) if t else ()
                if not own:
                    continue
                n_docs, n_terms = n_docs + 1, n_terms + len(own)
                before, own = len(df), set(own)
                df.update(own)
                if len(df) > before:
                    size += sum(map(len, own)) if len(own) < 4 else (len(df) - before) * sum(map(len, own)) // len(own)
                if len(df) > HELD_TERMS or size > HELD_BYTES:
                    yield rows(df)
                    df, size = Counter(), 0
        yield rows(df)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["term", "df", "total"])

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "term binary, df long, total long")
    return counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def frequent_terms(vocabulary: DataFrame) -> list:
    """At most FREQUENT terms (term, df), those in most documents: all above a bound on df. The bound is taken from the
    numbers of terms by df, counted exactly up to 64 and by its leading six binary digits above."""
    digits = F.greatest(F.lit(0), F.floor(F.log2(F.col("df"))).cast("int") - 5)
    low = F.expr("shiftleft(shiftright(df, digits), digits)")
    sizes = vocabulary.where(F.length("term") <= TERM_BYTES).withColumn("digits", digits).groupBy(low.alias("low")).agg(F.count("*").alias("n")).collect()  # 32 a power of two at most
    bound, total = None, 0
    for r in sorted(sizes, reverse=True):
        total += r["n"]
        if total > FREQUENT:
            break
        bound = r["low"]
    return [] if bound is None else vocabulary.where((F.length("term") <= TERM_BYTES) & (F.col("df") >= bound)).collect()


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    vocabulary = written(count_terms(docs, text), "search-terms")
    whole = vocabulary.where("term is null").first()
    n_docs, n_terms = (whole["df"], whole["total"]) if whole else (0, 0)
    vocabulary = vocabulary.where("term is not null").select("term", "df")
    frequent = frequent_terms(vocabulary)
    known = {bytes(r["term"]): (zlib.crc32(r["term"]) % WIDTH) | weight(n_docs, r["df"]) << 16 for r in frequent}
    most = weight(n_docs, 1)
    unit = -(-max(1, most) * 1000000 // 65535)
    id_type = docs.schema[id_col].dataType

    @released
    def run(batches):
        for batch in batches:
            ns, coordinates, values = [], [], []
            for t in batch.column(1).to_pylist():
                counts = Counter(terms(t) if t else ())
                n = counts.total()
                ns.append(n)
                if not n:
                    coordinates.append(b"")
                    values.append(b"")
                    continue
                m = length_factor(n, n_docs, n_terms)
                both = np.fromiter((known.get(x) or zlib.crc32(x) % WIDTH | most << 16 for x in counts), np.int64, len(counts))
                tf = np.fromiter(counts.values(), np.int64, len(counts))
                at, impact = both & 0xFFFF, (both >> 16) * saturation(tf, m)
                order = np.lexsort((impact, at))
                at, impact = at[order], impact[order]
                last = np.append(at[1:] != at[:-1], True)  # the largest of each coordinate
                coordinates.append(at[last].astype("<u2").tobytes())
                values.append((-(-impact[last] // unit)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ns, pa.int64()), pa.array(coordinates, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "text", "n", "coordinates", "values"])

    schema = f"doc_id {id_type.simpleString()}, text binary, n long, coordinates binary, values binary"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)
    return Index(written(rows.where("n > 0"), "search-index"), vocabulary, n_docs, n_terms, unit)


def blocks_of(queries: DataFrame, id_col: str, text: str):
    """The queries that have terms as lists of (id, {term: times}), each list bounded."""
    block, size = [], 0
    for r in queries.select(id_col, text).toLocalIterator():
        own = Counter(terms((r[1] or "").encode()))
        if not own:
            continue
        block.append((r[0], own))
        size += len(r[1])
        if len(block) >= BLOCK_QUERIES or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _look_up(index: Index, block, k: int) -> DataFrame:
    """query (its number in the block), doc_id, score: the best k of every task."""
    spark = index.rows.sparkSession
    wanted = spark.createDataFrame([(bytearray(t),) for t in {t for _, own in block for t in own}], "term binary")
    df = {bytes(r["term"]): r["df"] for r in index.vocabulary.join(F.broadcast(wanted), "term", "left_semi").collect()}
    # by query: its terms that documents have, with times and weight
    known = [[(t, times, weight(index.n_docs, df[t])) for t, times in own.items() if t in df] for _, own in block]
    column = {c: i for i, c in enumerate(sorted({zlib.crc32(t) % WIDTH for q in known for t, _, _ in q}))}
    caps = [np.array([-(-w * 1000000 // index.unit) for _, _, w in q], np.int64) for q in known]
    columns, times = [np.array([column[zlib.crc32(t) % WIDTH] for t, _, _ in q], np.int64) for q in known], [np.array([x for _, x, _ in q], np.float64) for q in known]
    place = np.full(WIDTH, -1, np.int32)
    place[list(column)] = list(column.values())
    n_docs, n_terms, unit, at_once = index.n_docs, index.n_terms, index.unit, max(16, BATCH_CELLS // max(1, len(column)))
    item_type = index.rows.schema["doc_id"].dataType

    def dense(coordinates, values):
        out = np.zeros((len(coordinates), len(column)), np.uint16)
        at = place[np.frombuffer(b"".join(coordinates), "<u2")]
        rows = np.repeat(np.arange(len(coordinates)), [len(c) // 2 for c in coordinates])
        there = at >= 0
        out[rows[there], at[there]] = np.frombuffer(b"".join(values), "<u2")[there]
        return out

    @released
    def run(batches):
        best: list[list] = [[] for _ in known]  # by query, a heap of (score, least id last, id)
        for batch in batches:
            ids, texts, ns, cs, vs = (c.to_pylist() for c in batch.columns)
            for low in range(0, len(ids), at_once):
                sketches = dense(cs[low : low + at_once], vs[low : low + at_once])
                counts: dict[int, tuple] = {}
                for heap, q, cap, cols, x in zip(best, known, caps, columns, times):
                    if not q:
                        continue
                    bounds = np.minimum(sketches[:, cols], cap) @ x * unit
                    least = heap[0][0] if len(heap) == k else 1
                    near = np.flatnonzero(bounds >= least)
                    for i in near[np.argsort(-bounds[near], kind="stable")].tolist():
                        if len(heap) == k and bounds[i] < heap[0][0]:
                            break
                        if i not in counts:
                            counts[i] = Counter(terms(texts[low + i])), length_factor(ns[low + i], n_docs, n_terms)
                        tfs, m = counts[i]
                        score = sum(n * w * saturation(tfs[t], m) for t, n, w in q if t in tfs)
                        doc = ids[low + i]
                        entry = (score, (0, 0) if doc is None else (1, -doc), doc)
                        if score > 0 and (len(heap) < k or entry[:2] > heap[0][:2]):
                            (heapq.heappushpop if len(heap) == k else heapq.heappush)(heap, entry)
        found = [(i, doc, score) for i, heap in enumerate(best) for score, _, doc in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=["query", "doc_id", "score"])

    return index.rows.select(F.col("doc_id").cast("long"), "text", "n", "coordinates", "values").mapInArrow(run, "query long, doc_id long, score long").withColumn("doc_id", F.col("doc_id").cast(item_type))


def _best(found: DataFrame, k: int, *keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 20, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: for each query the k documents (integer ids) of highest score above 0."""
    spark, out = queries.sparkSession, None
    kind = queries.schema[id_col].dataType.simpleString()
    schema = f"query long, item_id {kind}"
    for block in blocks_of(queries, id_col, text) if index.n_terms else ():
        found = _best(_look_up(index, block, k).withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))), k, "query", "_group").drop("rank", "_group")
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(block)], schema)  # at most BLOCK_QUERIES rows
        own = _best(found, k, "query").join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = own if out is None else out.unionByName(own)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {index.rows.schema['doc_id'].dataType.simpleString()}, score long")
    return out


def op12_sketch_search(spark, sf_dir):
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), tfs AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
ns AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM ns),
ws AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY ALL), whole),
ms AS (SELECT doc_id, 75 + ((25 * n * n_docs) // n_terms) AS m FROM ns, whole),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN tfs USING (term) JOIN ws USING (term) JOIN ms USING (doc_id) GROUP BY ALL
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
