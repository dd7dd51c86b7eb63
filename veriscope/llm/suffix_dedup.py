"""Removal of byte passages that repeat across documents, by blockwise sorting of suffixes with a difference cover.

A byte goes if a LENGTH-byte string that covers it also starts in a document of a smaller id. Suffixes are compared to
that depth. They are dealt into buckets by content: a suffix's bucket is its anchor, the GRAM-byte string of the least
hash among those inside its first LENGTH bytes, so equal suffixes share a bucket, wherever they stand. Then

1. each anchor's hash goes to a block with its text; anchors of a single text are dropped: nothing in their buckets
   can repeat. (Equal texts count as one here; copies of a text are settled by its hash.)
2. the others send the bytes around them that hold the suffixes of their bucket to their block;
3. a block sorts one bucket offset at a time. Ranks of the samples at difference cover positions (COVER modulo PERIOD)
   are made first; a suffix is then compared by its bytes up to the next sample (fewer than PERIOD), the bytes after that
   sample, and its rank: 16 bytes instead of LENGTH, however long a tie is. Only equality of the first LENGTH bytes
   matters here, so no deeper order is made. A block's memory is its anchors' surroundings and one offset's keys.

Defined results: a null or empty text has 0 bytes and nothing removed; texts under LENGTH bytes keep all; rows with the
same id never remove bytes from each other, and each text of an id has its own runs (a text is known by its id and
64-bit key); null ids count as one id above all others; equal rows get equal results; an empty table gives an empty one; extra
columns are ignored. Texts are used whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import table, written

#: Bytes of a passage; bytes of an anchor; anchors inside a passage.
LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
#: Bits kept of an anchor's hash. Anchors that share a hash by chance are only compared in vain.
HASH_BITS = 48
#: A difference cover: every distance modulo PERIOD is the difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of a sample: what is left of LENGTH after the longest way to a cover position.
SAMPLE = LENGTH - (PERIOD - 1)
#: Bytes around an anchor that hold all its suffixes, and where the anchor starts in them.
AROUND, LEAD = LENGTH + WINDOW - 1, WINDOW - 1
#: Bytes handled together, to bound memory; a longer text is handled alone, and whole.
BYTES_AT_ONCE = 1_500_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _extreme(x, n, f):
    """f over each n neighbours: result i is that of x[i : i + n]."""
    span = 1
    while span * 2 <= n:
        x = f(x[:-span], x[span:])
        span *= 2
    return f(x[: len(x) - (n - span)], x[n - span :]) if span < n else x


def anchors(data: np.ndarray, ends: np.ndarray):
    """Positions and hashes of all anchors in data, the texts that end at ends, one after the other; and for each position
    the hashes of the suffixes that start up to LEAD bytes before it, in a row (0: none starts there)."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    n = len(data) - GRAM + 1
    h = eight[:n] * _M[0]
    h ^= h >> np.uint64(31)
    h += eight[8 : n + 8] * _M[1]
    h ^= h >> np.uint64(29)
    h *= _M[2]
    h += eight[GRAM - 8 : n + GRAM - 8] * _M[3]
    h ^= h >> np.uint64(32)
    h *= _M[1]
    h ^= h >> np.uint64(30)
    h >>= np.uint64(64 - HASH_BITS)
    h |= np.uint64(1)  # 0 marks windows that are none
    least = _extreme(h, WINDOW, np.minimum)
    for e in ends[:-1]:  # windows over the end of a text
        least[max(0, e - LENGTH + 1) : e] = 0
    # an anchor is the least of some window around it
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    at = np.flatnonzero(_extreme(padded, WINDOW, np.maximum) == h)
    return at, h[at], padded


def _parts(texts):
    """Groups of texts: (first, one past the last, their bytes in a row, where each ends)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) <= BYTES_AT_ONCE:
            size += len(raw[hi])
            hi += 1
        yield lo, hi, np.frombuffer(b"".join(raw[lo:hi]), np.uint8), np.cumsum([len(x) for x in raw[lo:hi]])
        lo = hi


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance, which compress better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(b: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(k, -1).T).view(dtype).ravel()


def _by_block(h, blocks):
    """Positions by block of a hash, in order of the hash: (block, positions)."""
    block = (h >> np.uint64(1)) % np.uint64(blocks)
    order = np.lexsort((h, block))
    cut = np.flatnonzero(np.diff(block[order].astype(np.int64), prepend=-1))
    for a, e in zip(cut, [*cut[1:], len(order)]):
        yield int(block[order[a]]), order[a:e]


def _send_anchors(blocks):
    """Each text's distinct anchors, by block: hashes and which of the texts listed has them."""

    def run(batches):
        for b in batches:
            hs, of = [], []
            for lo, _, data, ends in _parts(b["text"]):
                at, h, _ = anchors(data, ends)
                hs.append(h)
                of.append(lo + np.searchsorted(ends, at, "right"))
            if not hs:
                continue
            # texts are numbered by key: equal ones are one, and keys in order need fewer bytes
            keys, number = np.unique(b["key"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
            h, of = np.concatenate(hs), number[np.concatenate(of)]
            order = np.lexsort((of, h))
            h, of = h[order], of[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) if len(h) else np.zeros(0, bool)
            h, of = h[new], of[new]
            for block, o in _by_block(h, blocks):
                texts, which = np.unique(of[o], return_inverse=True)
                yield pd.DataFrame({"block": [block], "h": [_planes(np.diff(h[o], prepend=np.uint64(0)))], "of": [_planes(which.astype("<u4"))], "keys": [_planes(np.diff(keys[texts], prepend=np.uint64(0)))]})

    return run


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a block's anchors, those of two texts or more, by text."""
    h = np.concatenate([np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in rows["h"]])
    key = np.concatenate([np.cumsum(_unplaned(k, np.uint64), dtype=np.uint64).view(np.int64)[_unplaned(x, "<u4")] for k, x in zip(rows["keys"], rows["of"])])
    order = np.lexsort((key, h))
    h, key = h[order], key[order]
    start = np.concatenate([[True], h[1:] != h[:-1]])
    group = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    several = np.zeros(len(first), bool)
    np.logical_or.at(several, group, key != key[first][group])
    keep = several[group]
    h, key = h[keep], key[keep]
    order = np.argsort(key, kind="stable")
    h, key = h[order], key[order]
    cut = np.flatnonzero(np.diff(key, prepend=~key[0])) if len(key) else np.zeros(0, np.int64)
    return pd.DataFrame({"key": key[cut], "hs": [x.tobytes() for x in np.split(h, cut[1:])] if len(cut) else []})


def _surroundings(data, ends, at, h, suffixes):
    """The AROUND bytes at each anchor, the first and last suffix in them whose anchor it is, its text and where that begins."""
    text = np.searchsorted(ends, at, "right")
    begin = np.concatenate([[0], ends[:-1]])[text]
    padded = np.concatenate([np.zeros(LEAD, np.uint8), data, np.zeros(AROUND, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[at]
    # these suffixes are neighbours: they lie between the nearest anchors of a lesser hash
    own = np.lib.stride_tricks.sliding_window_view(suffixes, WINDOW)[at] == h[:, None]
    low, high = own.argmax(1), WINDOW - 1 - own[:, ::-1].argmax(1)
    # bytes outside these suffixes say nothing
    place = np.arange(AROUND)
    around[(place < low[:, None]) | (place >= high[:, None] + LENGTH)] = 0
    return around, low, high, text, begin


_SENT = "block int, h binary, doc binary, key binary, pos binary, low binary, high binary, around binary, settled binary"


def _settled(block, ids, keys, starts, ends):
    """Runs that are known to go, on their way through some block."""
    none = {k: [b""] for k in ("h", "doc", "key", "pos", "low", "high", "around")}
    return pd.DataFrame({"block": [block], **none, "settled": [zlib.compress(_planes(np.concatenate([ids, keys, starts, ends]).astype(np.int64)), 1)]})


def _send_surroundings(blocks):
    """The surroundings of each text's repeated anchors, by block. Equal ones in a batch go once, with the smallest id;
    the others' suffixes all repeat, which is said at once (settled: ids, keys, s, e in a row: bytes s to e go)."""

    def run(batches):
        for b in batches:
            ids, keys, wanted = b["id"].to_numpy(np.int64), b["key"].to_numpy(np.int64), [np.frombuffer(b"".join(x), np.uint64) for x in b["hs"]]
            got = []
            for lo, hi, data, ends in _parts(b["text"]):
                at, h, suffixes = anchors(data, ends)
                text = np.searchsorted(ends, at, "right")
                cuts = np.searchsorted(text, np.arange(hi - lo + 1))
                keep = np.concatenate([np.isin(h[a:e], wanted[lo + k]) for k, (a, e) in enumerate(zip(cuts[:-1], cuts[1:]))]) if len(at) else np.zeros(0, bool)
                at, h = at[keep], h[keep]
                if not len(at):
                    continue
                around, low, high, text, begin = _surroundings(data, ends, at, h, suffixes)
                got.append((h, ids[lo + text], keys[lo + text], at - begin, low, high, around))
            if not got:
                continue
            h, doc, key, pos, low, high, around = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((doc, high, low, h))
            before, after = order[:-1], order[1:]
            equal = (h[before] == h[after]) & (low[before] == low[after]) & (high[before] == high[after]) & (around[before] == around[after]).all(1)
            lead = np.concatenate([[True], ~equal])
            head = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
            settled = order[doc[head] < doc[order]]
            rest = np.ones(len(h), bool)
            rest[settled] = False
            if len(settled):
                s = pos[settled] - LEAD + low[settled]
                yield _settled(int(h[0] % np.uint64(blocks)), doc[settled], key[settled], s, pos[settled] - LEAD + high[settled] + LENGTH)
            h, doc, key, pos, low, high, around = h[rest], doc[rest], key[rest], pos[rest], low[rest], high[rest], around[rest]
            for block, o in _by_block(h, blocks):
                yield pd.DataFrame({"block": [block], "h": [_planes(np.diff(h[o], prepend=np.uint64(0)))], "doc": [_planes(doc[o])], "key": [key[o].tobytes()], "pos": [_planes(pos[o].astype(np.int64))], "low": [low[o].astype(np.uint8).tobytes()], "high": [high[o].astype(np.uint8).tobytes()], "around": [zlib.compress(around[o].tobytes(), 1)], "settled": [b""]})

    return run


def _sorted(rows: np.ndarray):
    """Rows of bytes in their order, equal ones as they stood: (positions, whether each differs from the one before)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    columns = wide.view(">u8").astype(np.uint64).T
    order, lead = np.lexsort(columns[::-1]), np.zeros(len(rows), bool)
    lead[:1] = True
    for c in columns:
        c = c[order]
        lead[1:] |= c[1:] != c[:-1]
    return order, lead


def _ranked(rows: np.ndarray) -> np.ndarray:
    """The rank of each row of bytes, as four bytes."""
    order, lead = _sorted(rows)
    rank = np.empty(len(rows), ">u4")
    rank[order] = np.cumsum(lead) - 1
    return rank.view(np.uint8).reshape(-1, 4)


def repeats(h, doc, low, high, around) -> np.ndarray:
    """For each surrounding and suffix in it, whether the suffix starts in a document of a smaller id too."""
    by = np.argsort(doc, kind="stable")  # equal suffixes then stand by document
    h, doc, low, high, around = h[by], doc[by], low[by], high[by], around[by]
    bucket = np.unique(h, return_inverse=True)[1].astype(">u4").view(np.uint8).reshape(-1, 4)
    samples = {t: _ranked(np.concatenate([bucket, around[:, t : t + SAMPLE]], 1)) for t in range(AROUND - SAMPLE + 1) if t % PERIOD in COVER}
    out = np.zeros((len(h), WINDOW), bool)
    for s in range(WINDOW):
        own = np.flatnonzero((low <= s) & (s <= high))
        if len(own) < 2:
            continue
        t = next(t for t in range(s, s + PERIOD) if t % PERIOD in COVER)
        # bytes up to the sample, bytes after it, the sample's rank, which has the bucket in it
        around_s = around[own]
        order, lead = _sorted(np.concatenate([around_s[:, s:t], around_s[:, t + SAMPLE : s + LENGTH], samples[t][own]], 1))
        of = doc[own][order]
        out[by[own[order]], s] = of[np.flatnonzero(lead)[np.cumsum(lead) - 1]] < of
    return out


def _sort_block(rows: pd.DataFrame) -> pd.DataFrame:
    h = np.concatenate([np.cumsum(_unplaned(x, np.uint64), dtype=np.uint64) for x in rows["h"]])
    doc, pos = (np.concatenate([_unplaned(x, np.int64) for x in rows[c]]) for c in ("doc", "pos"))
    key, low, high = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("key", np.int64), ("low", np.uint8), ("high", np.uint8)))
    around = np.frombuffer(b"".join(zlib.decompress(x) for x in rows["around"] if x), np.uint8).reshape(-1, AROUND)
    gone = repeats(h, doc, low, high, around)
    # neighbouring suffixes give one run of bytes
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, a), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    known = np.concatenate([np.zeros((4, 0), np.int64), *(_unplaned(zlib.decompress(x), np.int64).reshape(4, -1) for x in rows["settled"] if x)], 1)
    found = (doc[i], key[i], pos[i] - LEAD + a, pos[i] - LEAD + e - 1 + LENGTH)
    return pd.DataFrame({k: np.concatenate([x, y]) for k, x, y in zip(("id", "key", "s", "e"), found, known)})


def merged(starts: np.ndarray, ends: np.ndarray):
    """Runs that touch or overlap as one."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)] if len(s) else e


def _cut_texts(batches):
    for b in batches:
        out = []
        for i, t, all_gone, s, e in zip(b["id"], b["text"], b["all_gone"], b["s"], b["e"]):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if all_gone and len(raw) >= LENGTH:
                s, e = np.array([0]), np.array([len(raw)])
            else:
                s, e = merged(np.asarray(s if s is not None else [], np.int64), np.asarray(e if e is not None else [], np.int64))
            kept, at = [], 0
            for a, z in zip(s.tolist(), e.tolist()):
                kept.append(raw[at:a])
                at = z
            rest = b"".join(kept) + raw[at:]
            out.append((i, len(raw), len(raw) - len(rest), len(s), hashlib.sha256(rest).hexdigest(), s.astype("<i8").tobytes(), e.astype("<i8").tobytes()))
        yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]).astype({"id": "Int64"})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256; starts, ends: the runs removed (int64)."""
    none = F.lit(2**63 - 1)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumns({"digest": F.unhex(F.md5("text")), "key": F.xxhash64("text", F.lit(7))})
    blocks = 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = written(d.select("id", "digest", "key").distinct(), "passage-texts")
    first = written(narrow.groupBy("digest").agg(F.min("id").alias("first"), F.first("key").alias("key")), "passage-firsts")
    sent = d.select("key", "text").mapInPandas(_send_anchors(blocks), "block int, h binary, of binary, keys binary")
    again = sent.groupBy("block").applyInPandas(_repeated, "key long, hs binary")
    wanted = again.groupBy("key").agg(F.collect_list("hs").alias("hs")).join(first, "key").select(F.col("first").alias("id"), "digest", "key", "hs")
    asked = d.select("id", "digest", "text").join(wanted, ["id", "digest"]).select("id", "key", "text", "hs")
    around = asked.mapInPandas(_send_surroundings(blocks), _SENT)
    runs = around.groupBy("block").applyInPandas(_sort_block, "id long, key long, s long, e long").groupBy("id", "key").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    verdict = narrow.join(first.select("digest", "first"), "digest").select("id", "digest", "key", (F.col("first") < F.col("id")).alias("all_gone"))
    verdict = verdict.join(runs, ["id", "key"], "left").select("id", "digest", "all_gone", F.transform("r", lambda x: x["s"]).alias("s"), F.transform("r", lambda x: x["e"]).alias("e"))
    # the texts were dealt by (id, digest) for the anchors already: the same shuffle serves here
    whole = d.select("id", "digest", "text").join(verdict, ["id", "digest"])
    out = whole.select("id", "text", "all_gone", "s", "e").mapInPandas(_cut_texts, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts binary, ends binary")
    return out.withColumn("id", F.nullif("id", none)).withColumnRenamed("id", id_col)


def op7_suffix_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).drop("starts", "ends")
