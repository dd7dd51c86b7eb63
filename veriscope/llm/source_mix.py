"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Source targets come from weights with a ceiling of MAX_COPIES times a source's size (the excess goes
to the others by weight). A document of a source with target / size = whole + part is taken `whole` times for
certain; one further copy goes to the documents with the smallest Pareto ranks

    q = (u / (1 - u)) / (p / (1 - p)),   u uniform from a hash of the id, p the inclusion probability,

up to the words that are left. Inclusion probabilities differ by document: p is `part` times the document's weight over
the mean weight of its source's words, so that the words expected are those that are left. The weight is the number of
binary digits of a document's size (longer documents are somewhat likelier), or the column named by `weight`.

The cut is found without ordering a source's documents in one task: ranks go into CELLS equal cells of q / (1 + q),
cells are summed map-side, and only the documents of the one cell that a source's target falls into are ordered.
Where the cut falls inside a document, that document is taken if this leaves the source nearer to its target. Documents
of equal rank are ordered by size and a hash of the text; of equal rows, as many as are wanted are taken.

Defined results: a null or empty text has size 0 and takes 0 words; the null source is a source, last in order;
documents with the same id share u; a null id is replaced by a hash of the text; equal rows are interchangeable, and
may be taken differently often; weights that are null or not above 0 count as the least above 0; an empty table gives an empty one; when every word is in sources at their ceilings, targets are the ceilings;
extra columns are ignored by ``mix`` and kept by ``sample_mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.llm.common import fresh, table, words_of, written

#: Weights by source in code point order, repeating; the share of all sizes that the mix holds; copies at most.
WEIGHTS, SHARE, MAX_COPIES = (3, 1, 2), 1.5, 2
#: Cells of the rank histogram.
CELLS = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """sizes(source, size) -> one row per source: source_size, weight, target.

    With sources ordered by ceiling / weight, those that stop at their ceiling come first; a running sum over this
    table of sources finds where they end, and the others share what is left by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), *([F.sum(F.col("size") * F.col("weight")).alias("weighed")] if "weight" in sizes.columns else []))
    weighed = ["weighed"] if "weight" in sizes.columns else []
    # both windows run over the few rows of the source table
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    by = by.withColumn("weight", w.cast("long")).withColumn("ceiling", (max_copies * F.col("source_size")).cast("long"))
    run = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source")
    before, here = run.rowsBetween(Window.unboundedPreceding, -1), run.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    by = by.withColumns({"level": (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0))) / F.sum("weight").over(here)})
    stops = F.col("ceiling") <= F.col("level") * F.col("weight")
    by = by.withColumn("stops", stops)
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("ceiling") / F.col("weight"), "level"))).over(everything)
    by = by.withColumn("final", final["level"])
    target = F.when(F.col("stops") | F.col("final").isNull(), F.col("ceiling").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return by.select("source", "source_size", "weight", target.alias("target"), *weighed)


def _uniform(id_col, text) -> F.Column:
    """Uniform in (0, 1), the same in every run: 52 bits of a hash of the id, or of the text where it has none."""
    key = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), key)), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def _ranked(rows: DataFrame) -> DataFrame:
    """rows with whole copies and cell-able Pareto ranks; rows has u, size, weight, source_size, weighed, target."""
    per_word = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(per_word)).withColumn("part", per_word - F.floor(per_word))
    # a probability of 1 or more is as good as certain: such documents come first
    p = F.when(F.col("size") > 0, F.least(F.col("part") * F.col("weight") * F.col("source_size") / F.col("weighed"), F.lit(1 - 1e-9))).otherwise(F.col("part"))
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    # q / (1 + q) keeps the order of q and lies in (0, 1); documents without a part stand at the end
    return rows.withColumn("rank", F.when(F.col("part") > 0, q / (1 + q)).otherwise(1.0)).withColumn("cell", F.least(F.floor(F.col("rank") * CELLS), F.lit(CELLS - 1)).cast("int"))


def _cuts(ranked: DataFrame) -> DataFrame:
    """One row per source: the cell that the words left fall into, the last (rank, size, hash) taken in that cell, and how many rows equal to it."""
    left = F.col("target") - F.col("whole") * F.col("source_size")
    cells = ranked.where("size > 0 and part > 0").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first(left).alias("left"))
    # a source has CELLS rows here at most, however many documents
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) - F.col("words")
    cut = cells.withColumn("before", upto).where("before < left and before + words >= left").select(F.col("source").alias("cut_source"), F.col("cell").alias("cut_cell"), (F.col("left") - F.col("before")).alias("rest"))
    inside = ranked.where("size > 0").join(cut, F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("cell") == F.col("cut_cell")))
    # equal rows count as one here, with their number
    at = inside.groupBy("cut_source", "cut_cell", "rest", "rank", "size", "hash").agg(F.count("*").alias("k"))
    so_far = F.sum(F.col("size") * F.col("k")).over(Window.partitionBy("cut_source").orderBy("rank", "size", "hash").rowsBetween(Window.unboundedPreceding, 0))
    # of k equal rows, those are taken that leave the source nearer to its target
    free = F.col("rest") - (so_far - F.col("size") * F.col("k"))
    taken = at.withColumn("m", F.least(F.col("k"), F.floor(free / F.col("size") + 0.5))).where("m > 0")
    last = taken.groupBy("cut_source").agg(F.max(F.struct("rank", "size", "hash", "m")).alias("last"))
    return cut.join(last.withColumnRenamed("cut_source", "s"), F.col("cut_source").eqNullSafe(F.col("s")), "left").select("cut_source", "cut_cell", "last")


def _with_copies(docs: DataFrame, id_col: str, text: str, source: str, weight: str | None, weights, share, max_copies, keep: list) -> DataFrame:
    t, size = F.col(text), F.size(words_of(F.col(text))).cast("long")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), size.alias("size"), _uniform(F.col(id_col), t).alias("u"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("hash"), *([F.col(weight).cast("double").alias("weight")] if weight else []), *keep)
    narrow = narrow.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1e-9) if weight else F.length(F.bin("size")))
    sized = written(narrow.drop("row"), "mix-sizes")
    own = narrow if keep else sized
    targets = written(source_targets(sized, weights, share, max_copies).drop("weight").coalesce(1), "mix-targets").withColumnRenamed("source", "t_source")
    join = lambda d: d.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    cuts = written(_cuts(_ranked(join(sized))).coalesce(1), "mix-cuts")
    out = _ranked(join(own)).join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    at, last = F.struct("rank", "size", "hash"), F.struct("last.rank", "last.size", "last.hash")
    in_cut = F.col("cell") == F.col("cut_cell")
    equal = F.coalesce((F.col("part") > 0) & in_cut & (at == last), F.lit(False))
    before = F.when(F.col("cut_cell").isNull(), False).when(in_cut, F.coalesce(at < last, F.lit(False))).otherwise(F.col("cell") < F.col("cut_cell"))
    # rows equal to a source's last one (one document, but for repeated rows) are numbered, by all that they hold, so that
    # reruns agree; no others move
    whole = F.xxhash64(F.to_json("row")) if keep else F.lit(0)
    number = F.row_number().over(Window.partitionBy("source", "rank", "size", "hash").orderBy(whole, *([F.to_json("row")] if keep else [])))
    some = out.where(equal).withColumn("more", (number <= F.col("last.m")).cast("int"))
    rest = out.where(~equal).withColumn("more", ((F.col("part") > 0) & before).cast("int"))
    return rest.unionByName(some).withColumn("copies", (F.col("whole") + F.col("more")).cast("int"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, taken (copies times size)."""
    out = _with_copies(docs, id_col, text, source, weight, weights, share, max_copies, [])
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def sample_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None, weights=WEIGHTS, share=SHARE, max_copies=MAX_COPIES) -> DataFrame:
    """The mixed corpus: each document's row as often as it is taken."""
    out = _with_copies(docs, id_col, text, source, weight, weights, share, max_copies, [F.struct(*docs.columns).alias("row")])
    n = fresh(docs, "_n")
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(n)).select("row.*")


def op8_source_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB: the same targets and ranks; all documents of a source in one order, up to the words that are left.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * length(bin(size)))::BIGINT AS weighed, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM d GROUP BY source
), s1 AS (SELECT *, 2 * source_size AS ceiling, row_number() OVER (ORDER BY 2 * source_size / weight, source NULLS LAST) AS k FROM s0),
s2 AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(ceiling) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s1
), s AS (
  SELECT source, source_size, weighed, CASE WHEN ceiling <= level * weight OR f IS NULL THEN ceiling::DOUBLE ELSE f * weight END AS target
  FROM s2, (SELECT arg_min(level, k) AS f FROM s2 WHERE ceiling > level * weight)
), r AS (
  SELECT d.*, source_size, weighed, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS per,
    (('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), p AS (
  SELECT *, floor(per) AS whole, CASE WHEN per > floor(per) THEN CASE WHEN size > 0 THEN least((per - floor(per)) * length(bin(size)) * source_size / weighed, 1 - 1e-9::DOUBLE) ELSE per - floor(per) END END AS p FROM r
), q AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM p
), c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q / (1 + q), size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN q IS NOT NULL AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
