"""Toxicity by a convolutional text classifier over hashed word embeddings, trained here in numpy.

A word's embedding is the sum of two rows of a hashed table: that of the word and that of its first five letters, so
that inflected forms share what they mean. Filters of WIDTHS words run over the embeddings; each filter's largest
response over the whole text (max pooling) goes into a logistic output. Because filters are linear, their response is
a sum of per-word projections, one for each place in the filter, which are computed once for each distinct word of
a batch.

The first number of an embedding starts at the log ratio of how often toxic and other texts have a hashed row (as in
naive Bayes), and filters of one word start by passing it through; training goes on from there. A language with fewer
than five toxic labels among the calibrating texts uses the common threshold.

Every labelled document outside the held-out third is learnt from, whole: a quarter (by a hash of the id) calibrates, the
others train. Rows are dealt by hash into shards; in each round a task walks a shard in small batches from the common
model on, and the changes of all shards are averaged (an embedding over the shards that have its words), as whole
numbers, so that the model does not depend on the order in which tasks end. Where one shard is enough that is plain
training. Log ratios, calibration and thresholds come from counts over all rows: for the calibration scores are counted in
steps of 1/CELLS. What meets in the driver has a fixed size: the parameters, BUCKETS counts, the steps of the scores.
Neither language nor source nor id is an input of a score.

Defined results: a null or empty text has no words and gets the score of a text without any response; ids without a
crc32 remainder (null) count as not held out; a labels table with no usable row gives the score 0.0 for all; of labelled
rows that share an id, the one with the least hash of its text is learnt from; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import settings, table, written

#: Rows of the hashed table, numbers in an embedding, filter widths, filters of each width.
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 6
#: Padding on each side of a text: the widest filter reaches from its first word, and from its last, over padding alone.
PAD = max(WIDTHS) - 1
#: One in so many labelled documents calibrates.
CALIBRATE = 4
#: Labelled documents of a shard, as long as there are at most MAX_SHARDS (beyond, shards grow: each sends its changes).
SHARD_ROWS, MAX_SHARDS = 8000, 256
ROUNDS, RATE, DECAY = 5, 0.08, 1e-5
#: Texts that one step of the training learns from; fewer, where they have more words than STEP_WORDS (a longer text: alone).
STEP_TEXTS, STEP_WORDS = 256, 500_000
#: Texts are scored together up to so many characters, to bound memory; a longer text is scored alone, and whole.
CHARS_AT_ONCE = 2_000_000
#: Places of a filter that are computed at once, in texts of any length.
PLACES_AT_ONCE = 1 << 20
#: Steps of a score that the calibration counts by, and the largest score it tells from larger ones.
CELLS, FARTHEST = 512, 64
#: Bits of a bitmap of Spark's aggregates.
BITS = 32_768
#: Changes of parameters travel as whole numbers of 1/FIXED.
FIXED = float(1 << 36)
_WORD = re.compile(r"\w+")
PREFIX = 5
PREDICT_FROM = 0.7


def _tables(word: str) -> tuple[int, int]:
    b = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(b) % BUCKETS, zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) % BUCKETS


def encode(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as word numbers in a row, where each text ends, and the hashed rows of each distinct word.

    Word 0 stands before and after every text (PAD times, for the wider filters) and has the rows of the empty word.
    """
    seen, rows, flat, ends = {"": 0}, [_tables("")], array("i"), []
    pad = array("i", [0] * PAD)
    for t in texts:
        flat.extend(pad)
        # the words of a long text one by one, never all in a list
        for w in _WORD.findall(t.lower()) if len(t) <= CHARS_AT_ONCE else (m[0] for m in _WORD.finditer(t.lower())):
            k = seen.get(w)
            if k is None:
                k = seen[w] = len(rows)
                rows.append(_tables(w))
            flat.append(k)
        flat.extend(pad)
        ends.append(len(flat))
    return np.array(flat, np.int32), np.array(ends, np.int64), np.array(rows, np.int64)


def together(texts):
    """The texts in lists of at most CHARS_AT_ONCE characters (a longer text alone), in order."""
    lo = 0
    while lo < len(texts):
        hi, chars = lo + 1, len(texts[lo])
        while hi < len(texts) and chars + len(texts[hi]) <= CHARS_AT_ONCE:
            chars += len(texts[hi])
            hi += 1
        yield texts[lo:hi]
        lo = hi


def keys_of(texts) -> list[np.ndarray]:
    """Each text as the hashed rows of its words, both in one number, with the padding around it."""
    out = []
    for some in together(texts):
        flat, ends, rows = encode(some)
        out += np.split((rows[:, 0] * BUCKETS + rows[:, 1]).astype(np.uint32)[flat], ends[:-1])
    return out


def numbered(keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What encode gives, from keys_of: words with the same hashed rows are one."""
    words, flat = np.unique(np.concatenate(keys), return_inverse=True)
    return flat.astype(np.int32), np.cumsum([len(k) for k in keys]), np.stack([words // BUCKETS, words % BUCKETS], 1).astype(np.int64)


def _projected(emb: np.ndarray, f: np.ndarray) -> np.ndarray:
    """emb @ f, added up in one order: a matrix product rounds a row by where it stands among the others."""
    out = emb[:, :1] * f[0]
    for k in range(1, DIM):
        out += emb[:, k : k + 1] * f[k]
    return out


class Cnn:
    """Embeddings e, filters f[width] (places, DIM, FILTERS) with bias b, output weights v with bias c, calibration.

    All parameters are parts of one array of DIM columns: BUCKETS rows of e, then f, then b, v and c.
    """

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.place(np.zeros((BUCKETS + (sum(WIDTHS) + 4) * FILTERS, DIM), np.float32))
        self.e[:] = rng.normal(0, 0.05, (BUCKETS, DIM))
        for w in WIDTHS:
            self.f[w][:] = rng.normal(0, 0.3, (w, DIM, FILTERS))
        self.v[:], self.c[:] = 0.5, -1.0
        self.scale, self.shift, self.limits = 1.0, 0.0, {}

    def place(self, params: np.ndarray) -> Cnn:
        self.params, self.e, self.f, self.b, at = params, params[:BUCKETS], {}, {}, BUCKETS
        for w in WIDTHS:
            self.f[w] = params[at : at + w * FILTERS].reshape(w, FILTERS, DIM).transpose(0, 2, 1)
            at += w * FILTERS
        rest, n = params[at:].reshape(-1), len(WIDTHS) * FILTERS
        for j, w in enumerate(WIDTHS):
            self.b[w] = rest[j * FILTERS : (j + 1) * FILTERS]
        self.v, self.c = rest[n : 2 * n], rest[2 * n : 2 * n + 1]
        return self

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("params", "scale", "shift", "limits")}

    def __setstate__(self, state):
        self.scale, self.shift, self.limits = state["scale"], state["shift"], state["limits"]
        self.place(state["params"])

    def pooled(self, flat, ends, rows, tracing=False):
        """Each text's largest response by filter, and where it is. Windows that reach over a text's end do not count."""
        emb = self.e[rows[:, 0]] + self.e[rows[:, 1]]
        starts = np.concatenate([[0], ends[:-1]])
        out, where = [], []
        for w in WIDTHS:
            place = [_projected(emb, self.f[w][k]) for k in range(w)]
            over = (ends[:, None] - np.arange(1, w)).ravel()
            top, at = np.full((len(ends), FILTERS), -np.inf, np.float32), np.zeros((len(ends), FILTERS), np.int64)
            for lo in range(0, len(flat), PLACES_AT_ONCE):
                hi = min(len(flat), lo + PLACES_AT_ONCE)
                n = max(0, min(hi, len(flat) - w + 1) - lo)
                response = np.full((hi - lo, FILTERS), -1e9, np.float32)
                response[:n] = place[0][flat[lo : lo + n]]
                for k in range(1, w):
                    response[:n] += place[k][flat[lo + k : lo + k + n]]
                response[:n] += self.b[w]
                response[over[(over >= lo) & (over < hi)] - lo] = -1e9
                own = slice(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left"))
                first = np.maximum(starts[own], lo) - lo
                best = np.maximum.reduceat(response, first, axis=0)
                if tracing:
                    here = np.array([lo + s + response[s:e].argmax(0) for s, e in zip(first, np.append(first[1:], hi - lo))])
                    at[own] = np.where(best > top[own], here, at[own])
                top[own] = np.maximum(top[own], best)
            out.append(top)
            where.append(at)
        return np.concatenate(out, 1), where

    def output(self, top) -> np.ndarray:
        return (np.maximum(top, 0) * self.v).sum(1) + self.c

    def raw(self, texts) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.output(self.pooled(*encode(some))[0]) for some in together(texts))])

    def score(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) * self.scale + self.shift, -30, 30)))

    def seed_words(self, count: np.ndarray, n0: int, n1: int):
        """First values: the first number of a hashed row is how much more often toxic texts have its words (log ratio).

        count: texts with a word of each hashed row, by label; n0 and n1: texts by label.
        """
        n0, n1 = max(1, n0), max(1, n1)
        ratio = np.log(((count[1] + 0.1) / n1) / ((count[0] + 0.1 * n0 / n1) / n0))
        self.e[:, 0] = np.where(count.sum(0) > 0, np.clip(ratio, -4, 4) * 0.25, 0)
        self.f[1][0, 0, :] = 1.0
        self.b[1][:] = -0.5
        return self

    def learn(self, keys, y, share, past):
        """One step of Adagrad on the log-likelihood; gradients run through the pooled positions alone.

        share: of label 1 among all texts; past: sums of squared gradients, an array like params.
        """
        local, stops, r = numbered(keys)
        y, sums = np.asarray(y, np.float32), Cnn.__new__(Cnn).place(past)

        def move(value, grad, g2, at=slice(None)):
            g2[at] += grad * grad
            value[at] -= RATE * grad / np.sqrt(g2[at])

        top, where = self.pooled(local, stops, r, True)
        act = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.v + self.c, -30, 30)))
        # both labels weigh alike however rare one is; calibration brings the true share back
        weight = np.where(y > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        d = ((p - y) * weight / len(y)).astype(np.float32)
        back = d[:, None] * self.v * (top > 0)
        emb, grads = self.e[r[:, 0]] + self.e[r[:, 1]], np.zeros((len(r), DIM), np.float32)
        for j, w in enumerate(WIDTHS):
            g = back[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                at = local[np.minimum(where[j] + k, len(local) - 1)]
                gf = np.einsum("nfd,nf->df", emb[at], g)
                np.add.at(grads, at.ravel(), (g[:, :, None] * self.f[w][k].T[None]).reshape(-1, DIM))
                move(self.f[w][k], gf + DECAY * self.f[w][k], sums.f[w][k])
            move(self.b[w], g.sum(0), sums.b[w])
        move(self.v, act.T @ d, sums.v)
        move(self.c, np.array([d.sum()], np.float32), sums.c)
        for k in (0, 1):
            u, inv = np.unique(r[:, k], return_inverse=True)
            g = np.zeros((len(u), DIM), np.float32)
            np.add.at(g, inv, grads)
            some = np.abs(g).sum(1) > 0
            move(self.e, g[some], sums.e, u[some])

    def new_past(self) -> np.ndarray:
        return np.full(self.params.shape, 1e-3, np.float32)

    def fit(self, texts, y, rounds=ROUNDS, seed=17):
        """Training on texts in memory, without calibration."""
        rng, y, keys, past = np.random.default_rng(seed), np.asarray(y), keys_of(texts), self.new_past()
        self.seed_words(_word_counts(keys, y), int((1 - y).sum()), int(y.sum()))
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), STEP_TEXTS):
                own = order[lo : lo + STEP_TEXTS]
                self.learn([keys[i] for i in own], y[own], y.mean(), past)
        return self

    def calibrate(self, scored: DataFrame):
        """Platt scaling on texts not trained on (z, y, lang); for each language the threshold of the best F1 (else the common one)."""
        cell = F.round(F.greatest(F.least("z", F.lit(FARTHEST)), F.lit(-FARTHEST)) * CELLS).cast("int")
        cells = scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("y").alias("n1")).orderBy("cell").toArrow().to_pandas()
        z, n, n1 = (cells[c].to_numpy(np.float64) for c in ("cell", "n", "n1"))
        z /= CELLS
        if 0 < n1.sum() < n.sum():
            a, b = 1.0, 0.0
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                g = np.array([((n * p - n1) * z).sum() + 1e-3 * (a - 1), (n * p - n1).sum()])
                w = n * p * (1 - p)
                h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
                da, db = np.linalg.solve(h, g)
                a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
            self.scale, self.shift = max(a, 0.05), b
        cuts = np.linspace(0.05, 0.95, 91)
        logit = F.greatest(F.least(F.col("z") * float(self.scale) + float(self.shift), F.lit(30.0)), F.lit(-30.0))
        s = 1 / (1 + F.exp(-logit))
        passed = sum((s >= float(t)).cast("int") for t in cuts).alias("passed")  # cuts are ascending: it passes the first so many
        of = scored.where("lang is not null").groupBy("lang", passed).agg(F.count("*").alias("n"), F.sum("y").alias("n1"))
        by = F.map_from_entries(F.collect_list(F.struct("passed", F.struct("n", "n1"))))
        # languages with toxic texts: a few dozen rows of at most 92 counts
        for r in of.groupBy("lang").agg(by.alias("by"), F.sum("n1").alias("n1")).where("n1 >= 5").orderBy("lang").toLocalIterator():
            at = np.zeros((2, len(cuts) + 1))
            for k, (n, n1) in r["by"].items():
                at[:, k] = n, n1
            flagged, hit = at[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
            f1 = 2 * hit / np.maximum(1, flagged + r["n1"])
            best = np.flatnonzero(f1 >= f1.max() - 1e-12)
            self.limits[r["lang"]] = float(cuts[best[len(best) // 2]])
        return self


def _word_counts(keys, y) -> np.ndarray:
    """Texts with a word of each hashed row, by label: a text counts once for words, and once for their beginnings."""
    count = np.zeros((2, BUCKETS), np.int64)
    for own, label in zip(keys, y):
        words = np.unique(own)
        for part in (words // BUCKETS, words % BUCKETS):
            count[int(label), np.unique(part)] += 1
    return count


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _encoded(batches):
    for b in batches:
        keys = [k.tobytes() for k in keys_of(b["t"].tolist())]
        yield b.drop(columns="t").assign(keys=keys)


def _counted(batches):
    count = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        count += _word_counts((np.frombuffer(k, np.uint32) for k in b["keys"]), b["y"])
    at = np.flatnonzero(count.sum(0))
    yield pd.DataFrame({"at": at, "n0": count[0, at], "n1": count[1, at]})


def steps(rows):
    """(shard, y, keys) in lists for one step each: of one shard, at most STEP_TEXTS texts and STEP_WORDS words (a longer text alone)."""
    own, words = [], 0
    for shard, y, keys in rows:
        if own and (shard != own[0][0] or len(own) == STEP_TEXTS or words + len(keys) > STEP_WORDS):
            yield own
            own, words = [], 0
        own.append((shard, y, keys))
        words += len(keys)
    if own:
        yield own


_MOVED = [f"{x}{k}" for x in "dg" for k in range(DIM)]


def _round(shared, share):
    """For the rows of a task: what a walk through each shard changes, by row of the parameters, and of the squared gradients."""

    def moved(model, past):
        params, past0 = shared.value
        at = np.flatnonzero((past != past0).any(1))
        change = np.concatenate([model.params[at].astype(float) - params[at], past[at].astype(float) - past0[at]], 1)
        return pd.DataFrame(np.rint(change * FIXED).astype(np.int64), columns=_MOVED).assign(at=at)[["at", *_MOVED]]

    def run(batches):
        rows = ((s, y, np.frombuffer(k, np.uint32)) for b in batches for s, y, k in zip(b["shard"], b["y"], b["keys"]))
        model = at = past = None
        for own in steps(rows):
            if own[0][0] != at:
                if model is not None:
                    yield moved(model, past)
                at, past = own[0][0], shared.value[1].copy()
                model = Cnn.__new__(Cnn).place(shared.value[0].copy())
            model.learn([k for _, _, k in own], [y for _, y, _ in own], share, past)
        if model is not None:
            yield moved(model, past)

    return run


def _scored(shared):
    def run(batches):
        for b in batches:
            rows = ((0, y, np.frombuffer(k, np.uint32)) for y, k in zip(b["y"], b["keys"]))
            z = [shared.value.output(shared.value.pooled(*numbered([k for _, _, k in own]))[0]) for own in steps(rows)]
            yield b.drop(columns="keys").assign(z=np.concatenate([np.zeros(0), *z]).astype(float))

    return run


def _maybe(own: DataFrame, usable: DataFrame) -> DataFrame:
    """own without most rows whose id is not among the usable ones: few texts move then. Two bytes of a bitmap for each id are broadcast."""
    slots = max(1, -(-usable.count() // (BITS // 16)))
    slot, place = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(slots)).cast("int"), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(BITS)).cast("int")
    maps = written(usable.select(slot.alias("slot"), place.alias("place")).groupBy("slot").agg(F.expr("bitmap_construct_agg(place)").alias("bits")), "toxic-ids")
    byte = F.conv(F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return own.withColumn("slot", slot).join(F.broadcast(maps), "slot").where(F.getbit(byte, place % 8) == 1).drop("slot", "bits")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text: str, lang: str, label: str) -> DataFrame:
    """id, t, lang, y: each labelled document outside the held-out third, one row for each id."""
    usable = labels.where(~held_out(F.col(id_col)) & F.col(label).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("t"), F.col(lang).alias("lang")).where(~held_out(F.col("id")))
    if own.schema["id"].dataType == usable.schema["id"].dataType:
        own = _maybe(own, usable)
    r = F.min_by(F.struct("t", "lang", "y"), F.struct(F.xxhash64("t"), F.col("t"), F.col("y")))
    return own.join(usable, "id").groupBy("id").agg(r.alias("r")).select("id", "r.t", "r.lang", "r.y")


def train_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Cnn:
    """The model that the labelled documents outside the held-out third give, all of them."""
    spark = docs.sparkSession
    rows = labelled(docs, labels, id_col, text, lang, label)
    shards = min(MAX_SHARDS, max(1, -(-rows.select("id").count() // SHARD_ROWS)))
    of = rows.select("t", "lang", "y", (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(CALIBRATE)) > 0).alias("learn"), F.xxhash64("id", F.lit(1)).alias("h"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"))
    keys = of.mapInPandas(_encoded, "lang string, y int, learn boolean, h long, shard int, keys binary")
    # one file for each shard, so that a task has all of it
    rows = written(keys.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "keys"), "toxic-words")
    train, model = rows.where("learn").select("shard", "y", "keys"), Cnn()
    n = {(r["learn"], r["y"]): r["count"] for r in rows.groupBy("learn", "y").count().collect()}
    if len({y for _, y in n}) < 2:
        model.c[:], model.v[:] = -30.0, 0
        return model
    n0, n1 = n.get((True, 0), 0), n.get((True, 1), 0)
    small = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    with settings(spark, small):  # tasks of a shard or two, and no shuffle files left of a round
        count = np.zeros((2, BUCKETS))
        got = train.mapInPandas(_counted, "at int, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
        count[:, got["at"].to_numpy()] = got["n0"].to_numpy(), got["n1"].to_numpy()
        model.seed_words(count, n0, n1)
        past = model.new_past()
        for _ in range(ROUNDS):
            shared = spark.sparkContext.broadcast((model.params, past))  # a fixed size
            moved = train.mapInPandas(_round(shared, n1 / max(1, n0 + n1)), ", ".join(f"{c} long" for c in ["at", *_MOVED]))
            got = moved.groupBy("at").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _MOVED]).toArrow()
            at, mean = got["at"].to_numpy(), np.stack([got[c].to_numpy() for c in _MOVED], 1) / FIXED / got["n"].to_numpy()[:, None]
            model.params[at] = model.params[at] + mean[:, :DIM]  # in doubles: of one shard, what it came to
            past[at] = past[at] + mean[:, DIM:]
            shared.unpersist()
        shared = spark.sparkContext.broadcast(model)
        z = rows.where("not learn").select("y", "lang", "keys").mapInPandas(_scored(shared), "y int, lang string, z double")
        return model.calibrate(written(z, "toxic-scores"))


def score_toxicity(docs: DataFrame, model: Cnn, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: id, held_out, score, predicted, threshold of its language, flagged (score from it on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size: some BUCKETS x DIM numbers

    @F.pandas_udf("double")
    def score_of(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()).astype(float))

    scored = docs.select(F.col(id_col), F.col(lang).alias("lang"), score_of(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    limits = F.create_map(*[F.lit(x) for kv in model.limits.items() for x in kv]) if model.limits else F.create_map().cast("map<string,double>")
    threshold = F.coalesce(F.try_element_at(limits, F.coalesce("lang", F.lit(""))), F.lit(PREDICT_FROM))
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"), threshold.alias("threshold"), (F.col("score") >= threshold).alias("flagged"))


def op4_toxic_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_on(docs, table(spark, sf_dir, "labels")))
