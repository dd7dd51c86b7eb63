"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Every vector x (scaled to length 1) is written as q / s + e: q int8, s = 127 / max|x|, and the length of e is
measured, not estimated. For two vectors

    |x.y - (q_x/s_x).(q_y/s_y)| <= |e_x| + |e_y| + |e_x||e_y|

so a pair whose integer product leaves it below the threshold by more than that bound is settled; only the others
are computed again in double precision.

Which tiles meet: each vector belongs to the nearest of some centres (vectors of a bounded sample, at most CENTRES; the
choice changes no result) and to a degree of angle from it. These cells are counted over all vectors and packed, near
centres together, into groups of bounded memory; a cell too large for one group is split. A vector goes to a group only
if it can have a partner there: its angle to the centre of one of the group's cells leaves that cell's angles by no more
than the threshold's angle (triangle inequality). Each pair of groups is one task. Clustered vectors thus meet their
surroundings only; vectors without clusters meet all groups, of which there are as few as a task's memory allows.
A task hands on only link counts and a spanning forest of the links that it found, so large groups of copies cost no
pair rows.

Defined results: null, zero, empty and non-finite vectors, and vectors of another length than their partner, link
with nothing; rows with the same id are vectors of their own that share the id's result (links between them count,
each row counting the other rows); a null id gives n_links of its row 0 and a null component. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import table, written
from veriscope.llm.components import connected_components

#: Vectors that a group holds at least where there are enough; bytes that it holds at most; vectors in a tile of the product.
GROUP, GROUP_BYTES, TILE = 8192, 32 << 20, 1024
#: Centres at most (twice the root of the number of vectors, below that); components of their sample at most; cells of a centre.
CENTRES, SAMPLED, DEGREES = 1024, 1 << 20, 180
#: Components up to which float32 holds the integer products exactly (127 * 127 * 1,040 < 2 ** 24); double does beyond.
EXACT_DIM = 1040
#: Room for rounding of the scaled products.
SLACK = 1e-5

_PACKED = "lo int, hi int, g int, n int, dim int, ids binary, q binary, s binary, err binary, x binary"


def _scaled(vectors):
    """Vectors of one length by a power of two each, so that nothing is rounded: squares neither overflow nor vanish then."""
    raw = np.stack(vectors).astype(np.float64)
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def _unit(raw):
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def _angles(x, centres):
    """Angles between unit vectors and centres, the shorter ones continued by zeros."""
    m = min(x.shape[1], centres.shape[1])
    return np.arccos(np.clip(x[:, :m] @ centres[:, :m].T, -1, 1))


def _by_length(vectors):
    """Positions of vectors of one length, and these vectors scaled."""
    lengths = np.array([len(v) for v in vectors])
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, _scaled([vectors[i] for i in at])


def _centres(sample, most, least_angle):
    """Up to most unit vectors of the sample, no two within least_angle of each other, as rows of one width; in an order
    that goes from each to the nearest of those left."""
    if not sample:
        return np.zeros((1, 1))
    wide = np.zeros((len(sample), max(map(len, sample))))
    for at, raw in _by_length(sample):
        wide[at, : raw.shape[1]] = _unit(raw)
    chosen, free = [], np.ones(len(wide), bool)
    while free.any() and len(chosen) < most:
        chosen.append(int(free.argmax()))
        free &= wide @ wide[chosen[-1]] < np.cos(least_angle)
        free[chosen[-1]] = False
    c = wide[chosen]
    order, left = [0], np.ones(len(c), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, c @ c[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return c[order]


def _assign(centres):
    """Each vector with its nearest centre, its degree of angle from it, and a number that splits large cells."""

    def run(batches):
        for b in batches:
            vectors = list(b["vec"])
            c, degree = np.zeros(len(b), np.int32), np.zeros(len(b), np.int32)
            for at, raw in _by_length(vectors) if vectors else ():
                angle = _angles(_unit(raw), centres)
                c[at] = angle.argmin(1)
                degree[at] = np.minimum(np.degrees(angle.min(1)).astype(np.int32), DEGREES - 1)
            yield b.assign(c=c, degree=degree, r=np.arange(len(b), dtype=np.int32))

    return run


def _groups(counts, size):
    """Cells, counted as (centre, degree, vectors), packed into groups of about size vectors: rows (centre, degree, first group, number
    of groups), and each group's cells as (group, centre, least degree, greatest degree), by group."""
    of, cells, g, room = [], [], 0, 0
    for c, degree, n in sorted(counts):
        parts = -(-n // size)
        if parts > 1 or n > room:
            g, room = g + (room < size and bool(of)), size
        if parts > 1:
            cells += [(g + k, c, degree, degree) for k in range(parts)]
            of.append((c, degree, g, parts))
            g, room = g + parts - 1, 0
            continue
        room -= n
        of.append((c, degree, g, 1))
        if cells and cells[-1][:2] == (g, c):
            cells[-1] = (g, c, cells[-1][2], degree)
        else:
            cells.append((g, c, degree, degree))
    return of, cells


def _pack(centres, cells, reach):
    """Each group's vectors as columns of bytes, once for each group where they may have partners."""
    cell_group, cell_c, low, high = np.array(cells, np.int64).reshape(-1, 4).T
    first = np.flatnonzero(np.diff(cell_group, prepend=-1))
    low, high = np.radians(low) - reach - SLACK, np.radians(high + 1) + reach + SLACK

    def run(batches):
        for b in batches:
            for g, rows in b.groupby("g"):
                ids, vectors = rows["id"].to_numpy(np.int64), list(rows["vec"])
                for at, raw in _by_length(vectors):
                    x = _unit(raw)
                    s = 127.0 / np.abs(x).max(axis=1)
                    q = np.rint(x * s[:, None]).astype(np.int8)
                    err = np.linalg.norm(x - q / s[:, None], axis=1)
                    single = raw.astype(np.float32)
                    exact = single if (single == raw).all() else raw
                    near = np.zeros((len(at), len(first)), bool)
                    for i in range(0, len(at), TILE):
                        angle = _angles(x[i : i + TILE], centres)[:, cell_c]
                        near[i : i + TILE] = np.logical_or.reduceat((low <= angle) & (angle <= high), first, axis=1)
                    near[:, g] = True
                    for h in np.flatnonzero(near.any(0)):
                        o = np.flatnonzero(near[:, h])
                        yield pd.DataFrame({"lo": [min(g, h)], "hi": [max(g, h)], "g": [g], "n": [len(o)], "dim": [raw.shape[1]], "ids": [ids[at[o]].tobytes()], "q": [q[o].tobytes()], "s": [s[o].tobytes()], "err": [err[o].tobytes()], "x": [exact[o].tobytes()]})

    return run


class _Forest:
    """Trees over positions, each with its smallest position as label; keeps the links that joined two trees."""

    def __init__(self, n):
        self.label, self.links = np.arange(n), []

    def join(self, a, b):
        while True:
            p, q = self.label[a], self.label[b]
            apart = p != q
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], np.minimum(p, q)[apart], np.maximum(p, q)[apart]
            # each tree is hung once a round, under one of the smaller labels that it meets
            trees, first = np.unique(high, return_index=True)
            self.links += zip(a[first].tolist(), b[first].tolist())
            up = np.arange(len(self.label))
            up[trees] = low[first]
            while not (up[up] == up).all():
                up = up[up]
            self.label = up[self.label]


def _side(rows):
    g = {k: np.frombuffer(b"".join(rows[k]), t) for k, t in (("ids", np.int64), ("s", np.float64), ("err", np.float64))}
    dim = int(rows["dim"].iloc[0])
    g["q"] = np.frombuffer(b"".join(rows["q"]), np.int8).reshape(-1, dim)
    # components go as floats where these hold them exactly
    exact = [np.frombuffer(x, f"<f{len(x) // (n * dim)}") for x, n in zip(rows["x"], rows["n"])]
    g["x"] = np.concatenate(exact).reshape(-1, dim)
    return g


def tile_links(a, b, same: bool, threshold: float):
    """Yields (i, j), positions in a and b, of all pairs at or above the threshold; with same, i < j only."""
    exact = np.float32 if a["q"].shape[1] <= EXACT_DIM else np.float64
    for i in range(0, len(a["q"]), TILE):
        qa = a["q"][i : i + TILE].astype(exact)
        for j in range(i if same else 0, len(b["q"]), TILE):
            sa, ea, sb, eb = a["s"][i : i + TILE], a["err"][i : i + TILE], b["s"][j : j + TILE], b["err"][j : j + TILE]
            product = qa @ b["q"][j : j + TILE].astype(exact).T  # whole numbers: exact
            product *= (1 / sb).astype(exact)
            # a row's smallest product that could reach the threshold with the tile's worst partner
            least = ((threshold - SLACK - ea - (1 + ea) * eb.max()) * sa).astype(exact)
            r, c = np.nonzero(product >= least[:, None])
            if same and i == j:
                r, c = r[r < c], c[r < c]
            near = product[r, c] / sa[r] + ea[r] + eb[c] + ea[r] * eb[c] >= threshold - SLACK
            r, c = r[near], c[near]
            for k in range(0, len(r), 65536):
                p, o = r[k : k + 65536] + i, c[k : k + 65536] + j
                x, y = a["x"][p].astype(np.float64), b["x"][o].astype(np.float64)
                cos = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                yield p[cos >= threshold], o[cos >= threshold]


def _compare(threshold):
    def run(key, rows):
        out_id, out_n, out_a, out_b = [], [], [], []
        for _, own in rows.groupby("dim"):
            g, h = int(key[0]), int(key[1])
            left, right = own[own["g"] == g], own[own["g"] == h]
            if not len(left) or not len(right):
                continue
            a = _side(left)
            b = a if g == h else _side(right)
            ids = a["ids"] if g == h else np.concatenate([a["ids"], b["ids"]])
            off, counts = (0 if g == h else len(a["ids"])), np.zeros(len(ids), np.int64)
            forest = _Forest(len(ids))
            for i, j in tile_links(a, b, g == h, threshold):
                j = j + off
                counts += np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                forest.join(i, j)
            some = np.flatnonzero(counts)
            out_id.append(ids[some])
            out_n.append(counts[some])
            out_a.append(ids[[i for i, _ in forest.links]].astype(np.int64))
            out_b.append(ids[[j for _, j in forest.links]].astype(np.int64))
        cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        i, n, a, b = map(cat, (out_id, out_n, out_a, out_b))
        return pd.DataFrame({"a": np.concatenate([i, a]), "b": pd.array([None] * len(i) + b.tolist(), dtype="Int64"), "n": np.concatenate([n, np.zeros(len(a), np.int64)])})

    return run


def dealt(sound: DataFrame, threshold: float, group: int | None = None) -> DataFrame:
    """Vectors packed for each pair of groups (lo, hi) in which they may have partners; group: vectors in a group."""
    n, dim = sound.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()
    if group is None:
        # as many tasks as run at once are enough; fewer groups mean fewer copies
        wide = int(np.ceil(np.sqrt(2 * sound.sparkSession.sparkContext.defaultParallelism)))
        group = max(1, min(GROUP_BYTES // (9 * dim + 24), max(GROUP, -(-n // wide))))
    reach = float(np.arccos(np.clip(threshold, -1, 1)))
    most = max(1, min(CENTRES, int(2 * np.sqrt(n)), SAMPLED // dim))
    size = max(1, min(8 * most, SAMPLED // dim))
    share = F.pmod(F.xxhash64("id", "vec"), F.lit(max(1, n // size))) == 0
    sample = sound.where(share).select("vec").limit(2 * size).toArrow()["vec"]  # the limit bounds repeated rows, which share a hash
    centres = _centres([v.values.to_numpy(zero_copy_only=False) for v in sample], most, reach)
    at = written(sound.mapInPandas(_assign(centres), "id long, vec " + sound.schema["vec"].dataType.simpleString() + ", c int, degree int, r int"), "embedding-cells")
    counts = [tuple(r) for r in at.groupBy("c", "degree").count().collect()]  # at most CENTRES * DEGREES rows
    of, cells = _groups(counts, group)
    known = F.broadcast(sound.sparkSession.createDataFrame(of, "c int, degree int, first int, parts int"))
    grouped = at.join(known, ["c", "degree"]).select("id", "vec", (F.col("first") + F.pmod("r", "parts")).alias("g"))
    return grouped.repartition("g").sortWithinPartitions("g").mapInPandas(_pack(centres, cells, reach), _PACKED)


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", group: int | None = None) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    sound = v.where("id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(vec, x -> x <> 0)")
    found = written(dealt(sound, threshold, group).groupBy("lo", "hi").applyInPandas(_compare(threshold), "a long, b long, n long"), "embedding-links")
    comps = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n_links"))
    times = sound.groupBy("id").agg(F.count("*").alias("times"))
    joined = v.select("id").join(counts.join(times, counts["a"] == times["id"]).select("a", (F.col("n_links") / F.col("times")).cast("long").alias("n_links")), F.col("id") == F.col("a"), "left").drop("a")
    joined = joined.join(comps.withColumnRenamed("id", "c"), F.col("id") == F.col("c"), "left")
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: DuckDB: cosine of all pairs in double precision, then labels spread to the smallest id.
ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(e) > 0 AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95
), reach(id, r) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.id
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(any_value(c.n), 0)::BIGINT AS n_links, min(reach.r) AS component_id, v.vec_id = min(reach.r) AS kept
FROM v JOIN reach ON reach.id = v.vec_id LEFT JOIN counts c ON c.a = v.vec_id GROUP BY v.vec_id
"""
