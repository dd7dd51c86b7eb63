"""Near-duplicate texts by the Jaccard similarity of their word n-grams: a blocked sparse product of the incidence matrix.

Rows of the matrix are the distinct n-gram sets, columns the n-grams (64-bit hashes of lower-cased words). Identical
sets are one row. For the product, a set needs to enter only its first n - ceil(t n) + SHARED columns in some order
common to all (t the similarity; two sets that share fewer than SHARED of these cannot reach t). The order puts
frequent columns last, by a fixed-size table of counts, so columns that many documents share are hardly ever multiplied.

Columns are dealt into blocks. In each, the overlaps of sets that share columns are counted, unless their sizes, or
their positions in a column, bound the overlap below what t needs; counts are summed over the blocks, and pairs of
too few are discarded. What is left is counted over the full sets. Long columns are multiplied in two steps, so that
groups of copies cost no square of their size: first with their first set and each with the next one; then, when these
links have made components, block by block between different ones. Every pair at or above t is found or lies within
one component already.

Defined results: a null text, an empty one and one of white space have no n-grams, n_shingles 0, and are linked with
nothing; fewer words than n count as one n-gram; repeated rows get equal results, row by row; rows of one id with
different texts share the links of both; an empty table gives an empty one; extra columns are ignored by ``components``
and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import fresh, released, table, written
from veriscope.llm.components import connected_components

#: log2 of the counters in the table of column counts, and how many go in one row of it.
SKETCH_BITS, CHUNK = 20, 1 << 14
#: Columns that two sets must share among their first ones (fewer where the sets are smaller).
SHARED = 4
#: Bits of a set's mark: one for each column's hash. A bit that one set has and the other lacks is a column it lacks.
MARK_BITS = 2048
#: A column with more sets than this is multiplied in two steps; sets in a block of such a column.
LONG, BLOCK = 32, 256
#: Characters hashed together, to bound memory; a longer text is hashed alone, and whole.
CHARS_AT_ONCE = 2_000_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: bytes):
    """Where words start in data, and a 64-bit hash of each, eight bytes at a time."""
    b = np.frombuffer(data + b" " * 8, np.uint8)
    edge = np.diff(_IS_SPACE[b].astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts) :] if len(ends) > len(starts) else ends
    size = ends - starts
    h = size.astype(np.uint64) * _M1
    eight = np.lib.stride_tricks.sliding_window_view(b, 8)
    at, k = np.arange(len(starts)), 0
    while len(at):
        chunk = np.ascontiguousarray(eight[starts[at] + k]).view("<u8").ravel()
        left = np.minimum(size[at] - k, 8).astype(np.uint64)
        chunk = chunk & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        h[at] = _mix(h[at] + chunk + _M1)
        k += 8
        at = at[size[at] > k]
    return starts, h


def shingle_sets(texts, n: int):
    """The sorted distinct n-gram hashes of each text."""
    out, lo = [], 0
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) <= CHARS_AT_ONCE:
            size += len(raw[hi])
            hi += 1
        part = raw[lo:hi]
        starts, h = _word_hashes(b" ".join(part))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in part]))
        grams = np.full(max(len(h) - n + 1, 0), n, np.uint64)
        for k in range(n):
            grams = _mix(grams * _M1 + h[k : k + len(grams)])
        for a, e in zip(bounds[:-1], bounds[1:]):
            if e - a >= n:
                out.append(np.unique(grams[a : e - n + 1]))
            elif e > a:
                g = np.array([e - a], np.uint64)
                for k in range(a, e):
                    g = _mix(g * _M1 + h[k : k + 1])
                out.append(g)
            else:
                out.append(np.zeros(0, np.uint64))
        lo = hi
    return out


def _survey(n):
    """For each text its set's size and digest; at the end of the partition, how often each counter's columns occur."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            sets = shingle_sets(b["text"], n)
            for lo in range(0, len(sets), 512):
                some = np.concatenate(sets[lo : lo + 512])
                counts += np.bincount((some >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "key": [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets], "chunk": pd.array([None] * len(b), dtype="Int32"), "counts": None})
        if counts.any():
            parts = counts.reshape(-1, CHUNK)
            yield pd.DataFrame({"id": pd.array([None] * len(parts), dtype="Int64"), "n": 0, "key": None, "chunk": pd.array(range(len(parts)), dtype="Int32"), "counts": [p.tobytes() for p in parts]})

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in rows["counts"])
    return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "counts": [total.tobytes()]})


def _levels(sketch: DataFrame) -> bytes:
    """One byte for each counter: 0 for usual ones, then two for each doubling of the mean count. Fixed size."""
    rows = sketch.groupBy("chunk").applyInPandas(_add, "chunk int, counts binary").collect()
    counts = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.float64).reshape(-1, CHUNK)
    for r in rows:
        counts[r["chunk"]] = np.frombuffer(r["counts"], np.uint64)
    mean = max(counts.mean(), 1.0)
    return np.clip(2 * np.log2(np.maximum(counts / mean, 1)), 0, 255).astype(np.uint8).tobytes()


def _least(size, percent):
    """How many of its first columns a set of this size must share with any set that it links to."""
    return np.minimum(SHARED, -(-percent * size // 100))


def _prefixes(n, percent, levels):
    """Each set's first columns, in the common order."""

    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        for b in batches:
            size, cols, marks = [], [], []
            for s in shingle_sets(b["text"], n):
                m = np.zeros(MARK_BITS, np.uint8)
                m[(s % np.uint64(MARK_BITS)).astype(np.int64)] = 1
                marks.append(np.packbits(m).tobytes())
                s = s[np.argsort(level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]
                size.append(len(s))
                cols.append(s[: len(s) - (-(-percent * len(s) // 100)) + _least(len(s), percent)].tobytes() if len(s) else b"")
            yield pd.DataFrame({"id": b["id"], "n": size, "mark": marks, "cols": cols})

    return run


def _deal(blocks):
    """Columns of many sets, dealt by block: one row of arrays for each block and batch."""

    def run(batches):
        for b in batches:
            cols = [np.frombuffer(c, np.uint64) for c in b["cols"]]
            k = np.array([len(c) for c in cols])
            if not k.sum():
                continue
            h = np.concatenate(cols)
            doc, size = np.repeat(b["id"].to_numpy(np.int64), k), np.repeat(b["n"].to_numpy(np.int32), k)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)
            block = (_mix(h) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cut = np.flatnonzero(np.diff(block[order], prepend=-1))
            for a, e in zip(cut, [*cut[1:], len(order)]):
                o = order[a:e]
                yield pd.DataFrame({"block": [int(block[o[0]])], "h": [h[o].tobytes()], "doc": [doc[o].tobytes()], "size": [size[o].tobytes()], "pos": [pos[o].tobytes()]})

    return run


def _reachable(na, nb, ia, ib, percent):
    """Whether sets of these sizes that meet at these positions can reach the similarity: at all, and if they meet here first."""
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    need = -(-percent * (na + nb) // (100 + percent))
    rest = 1 + np.minimum(na - ia - 1, nb - ib - 1)
    fit = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    return fit & (np.minimum(ia, ib) + rest >= need), fit & (rest >= need)


_FOUND = "a long, b long, n int, least int, first boolean, h long, part int, docs binary, sizes binary, places binary"


def _multiply(percent):
    """Counts of shared columns by pair, of a block; long columns give some pairs, and themselves in parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, doc, size, pos = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("h", np.uint64), ("doc", np.int64), ("size", np.int32), ("pos", np.int32)))
        order = np.lexsort((doc, size, h))
        h, doc, size, pos = h[order], doc[order], size[order], pos[order]
        cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(cut, len(h)))
        long = np.repeat(length > LONG, length)
        pairs, parts = [], []

        def add(i, j, settled):
            ok, first = _reachable(size[i], size[j], pos[i], pos[j], percent)
            ok &= doc[i] != doc[j]
            i, j = i[ok], j[ok]
            least = np.minimum(_least(size[i], percent), _least(size[j], percent))
            pairs.append((np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j]), least if settled else np.ones(len(i), np.int32), least, np.full(len(i), True) if settled else first[ok]))

        for d in range(1, LONG):
            i = np.flatnonzero((h[d:] == h[:-d]) & ~long[d:])
            if not len(i):
                break
            add(i, i + d, False)
        for c, m in zip(cut[length > LONG], length[length > LONG]):
            at = np.arange(c, c + m)
            eldest = c + int(doc[at].argmin())
            for one in {c, eldest}:
                others = at[at != one]
                add(np.full(m - 1, one), others, True)
            add(at[:-1], at[1:], True)
            parts += [(int(h[c].astype(np.int64)), k // BLOCK, doc[at[k : k + BLOCK]].tobytes(), size[at[k : k + BLOCK]].tobytes(), pos[at[k : k + BLOCK]].tobytes()) for k in range(0, m, BLOCK)]
        found = pd.DataFrame({k: np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i, k in enumerate(("a", "b", "n", "least", "first"))})
        found = found.groupby(["a", "b"], as_index=False).agg(n=("n", "sum"), least=("least", "first"), first=("first", "max"))
        return pd.concat([found, pd.DataFrame(parts, columns=["h", "part", "docs", "sizes", "places"])]).astype({"a": "Int64", "b": "Int64", "n": "Int32", "least": "Int32", "first": "boolean", "h": "Int64", "part": "Int32"})

    return run


def _across(percent):
    """Pairs of two parts of a long column whose sets lie in different components."""

    def run(batches):
        for b in batches:
            found = []
            for x in b.itertuples(index=False):
                d, s, p, c = (np.frombuffer(v, np.int64) for v in (x.docs, x.sizes, x.places, x.comps))
                e, t, q, f = (np.frombuffer(v, np.int64) for v in (x.docs2, x.sizes2, x.places2, x.comps2))
                ok, first = _reachable(s[:, None], t[None], p[:, None], q[None], percent)
                ok = ok & (c[:, None] != f[None])
                if x.part == x.part2:
                    ok &= np.arange(len(d))[:, None] < np.arange(len(e))[None]
                i, j = np.nonzero(ok)
                u, v = _marks([x.marks]), _marks([x.marks2])
                room = np.concatenate([np.zeros(0, bool), *(_bounded(s[i[k : k + 16384]], t[j[k : k + 16384]], u[i[k : k + 16384]], v[j[k : k + 16384]], percent) for k in range(0, len(i), 16384))])
                i, j = i[room], j[room]
                found.append(pd.DataFrame({"a": np.minimum(d[i], e[j]), "b": np.maximum(d[i], e[j]), "n": 1, "least": np.minimum(_least(s[i], percent), _least(t[j], percent)), "first": first[i, j]}))
            if found:
                yield pd.concat(found).groupby(["a", "b"], as_index=False).agg(n=("n", "sum"), least=("least", "first"), first=("first", "max"))

    return run


def _bounded(na, nb, x, y, percent):
    """Whether marks x and y of sets of these sizes leave room for the similarity: bits that the other lacks bound the overlap."""
    most = np.minimum(na - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return 100 * most >= percent * (na + nb - most)


def _marks(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, MARK_BITS // 64)


def _by_marks(percent):
    """Pairs whose sets' marks leave room for the similarity."""

    def run(batches):
        for b in batches:
            if len(b):
                yield b.loc[_bounded(b["na"].to_numpy(np.int64), b["nb"].to_numpy(np.int64), _marks(b["ma"]), _marks(b["mb"]), percent), ["a", "b"]]

    return run


def _count_overlaps(percent):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"]):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[keep, ["a", "b"]]

    return run


def _sets(n):
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "s": [s.tobytes() for s in shingle_sets(b["text"], n)]})

    return run


def _linked(pairs: DataFrame, cols: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs that reach the similarity: first bounded by marks, then counted over the full sets.

    No side of these joins has a bound on its size, so none is broadcast.
    """
    mark = lambda k: cols.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("mark").alias(f"m{k}")).hint("merge")
    left = written(pairs.join(mark("a"), "a").join(mark("b"), "b").mapInPandas(released(_by_marks(percent)), "a long, b long"), "shingle-candidates")
    wanted = left.select(F.col("a").alias("w")).union(left.select("b")).distinct()
    sets = written(docs.join(wanted.hint("merge"), F.col("id") == F.col("w"), "left_semi").mapInPandas(released(_sets(n)), "id long, s binary"), "shingle-sets")
    full = lambda k: sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")).hint("merge")
    return left.join(full("a"), "a").join(full("b"), "b").mapInPandas(released(_count_overlaps(percent)), "a long, b long")


def components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id. Two sets link if 100 x intersection >= percent x union."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    survey = written(d.mapInPandas(released(_survey(n)), "id long, n long, key binary, chunk int, counts binary"), "shingle-survey")
    own = survey.where("chunk is null").select("id", "n", "key")
    levels = spark.sparkContext.broadcast(_levels(survey.where("chunk is not null").select("chunk", "counts")))
    # the smallest id of each set stands for it
    first = own.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    first = written(first, "shingle-firsts")
    cols = d.mapInPandas(released(_prefixes(n, percent, levels)), "id long, n int, mark binary, cols binary").where("n > 0")
    cols = cols.join(first.select("rep").distinct(), F.col("id") == F.col("rep"), "left_semi")
    cols = written(cols.dropDuplicates(["id", "cols"]), "shingle-columns")
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cols.select("id", "n", "cols").mapInPandas(released(_deal(blocks)), "block int, h binary, doc binary, size binary, pos binary")
    found = written(dealt.groupBy("block").applyInPandas(_multiply(percent), _FOUND), "shingle-pairs")
    links = written(_linked(_enough(found), cols, d, n, percent), "shingle-links")
    comps = connected_components(links)
    parts = found.where("h is not null").select("h", "part", "docs", "sizes", "places")
    if not parts.isEmpty():
        more = _linked(_enough(found, _rest(parts, comps, cols, percent)), cols, d, n, percent)
        comps = connected_components(links.union(more))
    joined = own.join(first, "key", "left").join(comps.withColumnRenamed("id", "c"), F.col("rep") == F.col("c"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def _enough(found: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """Pairs that share as many columns as they must, and could reach the similarity where they first meet.

    With rest, counts of long columns: pairs that reach this with them, and did not without.
    """
    rows = found.where("a is not null").select("a", "b", "n", "least", "first", F.lit(False).alias("long"))
    if rest is not None:
        rows = rows.union(rest.select("a", "b", "n", "least", "first", F.lit(True)))
    by = rows.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.max("least").alias("least"), F.max("first").alias("first"), F.max("long").alias("long"),
        F.coalesce(F.sum(F.expr("if(long, null, n)")), F.lit(0)).alias("n0"), F.coalesce(F.max(F.expr("if(long, null, first)")), F.lit(False)).alias("first0"),
    )
    now = by.where("n >= least and first")
    return (now if rest is None else now.where("long and not (n0 >= least and first0)")).select("a", "b")


def _unpack(batches):
    for b in batches:
        k = [len(x) // 8 for x in b["docs"]]
        cat = lambda c, t: np.concatenate([np.frombuffer(x, t) for x in b[c]]) if len(b) else np.zeros(0, t)
        yield pd.DataFrame({"h": np.repeat(b["h"].to_numpy(np.int64), k), "part": np.repeat(b["part"].to_numpy(np.int32), k), "doc": cat("docs", np.int64), "size": cat("sizes", np.int32).astype(np.int64), "place": cat("places", np.int32).astype(np.int64)})


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    r = rows.iloc[0]
    return pd.DataFrame({"h": [r["h"]], "part": [r["part"]], "least": [rows["size"].min()], "most": [rows["size"].max()], **{c: [rows[k].to_numpy(np.int64).tobytes()] for c, k in (("docs", "doc"), ("sizes", "size"), ("places", "place"), ("comps", "comp"))}, "marks": [b"".join(rows["mark"])]})


def _rest(parts: DataFrame, comps: DataFrame, cols: DataFrame, percent: int) -> DataFrame:
    """Counts of shared long columns of pairs that the first links have not settled: those between different components."""
    one = parts.mapInPandas(released(_unpack), "h long, part int, doc long, size long, place long").join(comps, F.col("doc") == F.col("id"), "left")
    one = written(one.select("h", "part", "doc", "size", "place", F.coalesce("component", "doc").alias("comp")), "shingle-long")
    open_ = one.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("h")
    marked = one.join(open_, "h", "left_semi").join(cols.select(F.col("id").alias("doc"), "mark").hint("merge"), "doc")
    packed = marked.groupBy("h", "part").applyInPandas(_pack, "h long, part int, least long, most long, docs binary, sizes binary, places binary, comps binary, marks binary")
    packed = written(packed, "shingle-parts")
    other = packed.select(F.col("h").alias("h2"), *[F.col(c).alias(f"{c}2") for c in ("part", "least", "most", "docs", "sizes", "places", "comps", "marks")])
    meet = (F.col("h") == F.col("h2")) & (F.col("part") <= F.col("part2")) & (100 * F.col("most") >= percent * F.col("least2")) & (100 * F.col("most2") >= percent * F.col("least"))
    # a column of very many parts is a skewed key of this join, which adaptive execution splits
    return packed.join(other.hint("merge"), meet).mapInPandas(released(_across(percent)), "a long, b long, n int, least int, first boolean")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that have a document of a smaller id in their component; rows of one id stay together."""
    comps = components(docs, n, percent, id_col, text)
    out = comps.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(fresh(docs, "_gone"))).distinct()
    return docs.join(out, docs[id_col] == out[out.columns[0]], "left_anti")


def op9_shingle_join(spark, sf_dir):
    return components(table(spark, sf_dir, "documents"), n=4, percent=85)


#: DuckDB: links over shared n-grams, then labels spread to the smallest id.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w
), e AS (SELECT doc_id, unnest(g) AS g FROM s),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 85 * (len(x.g) + len(y.g) - i)
), reach(id, r) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id
)
SELECT s.doc_id, len(any_value(s.g))::BIGINT AS n_shingles, min(r) AS component_id FROM s JOIN reach ON reach.id = s.doc_id GROUP BY s.doc_id
"""
