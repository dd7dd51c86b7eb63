"""Byte-level BPE: ranked merges folded over the bytes of distinct words, by higher-order functions.

1. Words are counted over all documents. The most frequent ones (at most KEPT_WORDS, by exact counts) are folded once
   each and broadcast with their ids; they are some 95 % of all words of the tables tried.
2. Documents are coded with them. A rare word, and one of more than LONG code points, is merged where it stands by a
   small helper with the same ranks (a heap, n log n). No text and no ids move between tasks.
3. Decoding concatenates the binary pieces of the ids.

The fold: the state is the word's ids and the ranks of neighbouring pairs; a step merges the leftmost pair of the least
rank and looks up the two pairs that this changes. Ranks come from a literal: two arrays of integers, in which a pair of
ids is at one of two slots. A word that is a piece as a whole has that piece's rank. Folding the rare words as well costs
more than the check tool's limits leave (see the README).

Defined results: a null or empty text has no ids and decodes to nothing; texts and words of any length are encoded
whole; repeated rows give equal results; an empty table gives an empty one; other columns stay, but for the text. Which
words are kept changes no result. The vocabulary's file has the same path on all machines.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import fresh, released, settings, table, written

#: Words broadcast at most, each of up to LONG code points.
KEPT_WORDS, LONG = 1 << 18, 64
#: Distinct words counted together in a task; documents coded together.
COUNTED, TOGETHER = 150_000, 2_000
_NO_PAIR = 2**31 - 1
#: Texts of code points below this are split by a pattern of explicit classes, which is faster.
_LOW = 0x250

_loaded: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank by piece; read once in a process."""
    if ("ranks", path) not in _loaded:
        with open(path, "rb") as f:
            _loaded["ranks", path] = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return _loaded["ranks", path]


def read_pieces(path: str) -> pa.Array:
    """Piece by id."""
    if ("pieces", path) not in _loaded:
        ranks = read_ranks(path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        _loaded["pieces", path] = pa.array(pieces, pa.binary())
    return _loaded["pieces", path]


def splitter(pattern: str):
    """text -> its words, the matches of pattern."""
    if ("split", pattern) not in _loaded:
        spelled = {}
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            of = regex.compile(name)
            spelled[name] = "".join(rf"\u{c:04x}" for c in range(_LOW) if of.match(chr(c)))
        out, inside, at = "", False, 0
        while at < len(pattern):
            name = next((x for x in (*spelled, r"\S") if pattern.startswith(x, at)), pattern[at])
            inside = name == "[" or inside and name != "]"
            out += name if name not in spelled and name != r"\S" else rf"[^{spelled[r'\s']}]" if name == r"\S" else spelled[name] if inside else f"[{spelled[name]}]"
            at += len(name)
        low, whole, high = re.compile(out), regex.compile(pattern), re.compile(f"[^\\x00-{chr(_LOW - 1)}]")
        _loaded["split", pattern] = lambda text: low.findall(text) if high.search(text) is None else whole.findall(text)
    return _loaded["split", pattern]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word of any length: the pair of the least rank first, the leftmost among equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda i: ranks.get(word[i : end[end[i]]]) if end[i] < n else None
    heap = [(r, i, i + 2) for i in range(n) if (r := rank(i)) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01") * n
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
        for j in (i, before[i]):
            if j >= 0 and (r := rank(j)) is not None:
                heapq.heappush(heap, (r, j, end[end[j]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class PairTable:
    """Ranks of pairs of ids as literal arrays of integers; a pair is at one of two slots that its hash names, or has no rank."""

    def __init__(self, spark, ranks: dict[bytes, int]):
        size, pairs = max(ranks.values()) + 1, {}
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):
                if piece[:k] in ranks and piece[k:] in ranks:
                    pairs[ranks[piece[:k]], ranks[piece[k:]]] = rank
        self.shift, self.kind = (16, "int") if size <= 1 << 16 else (32, "bigint")
        # a row for each pair of pieces that the vocabulary joins; the hash is Spark's
        rows = spark.createDataFrame(pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}), "a int, b int").select(F.xxhash64("a", "b")).toArrow()
        hashes = rows.column(0).to_numpy()
        self.bits, at = max(4, (len(pairs) * 2).bit_length()), None
        while at is None:
            at = self._placed(hashes)
            self.bits += at is None
        keys, values = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        at, pair = np.array(at), np.array(list(pairs))
        key = pair[:, 0] << self.shift | pair[:, 1]
        keys[at], values[at] = key - ((key >> 31) << 32) if self.kind == "int" else key, list(pairs.values())
        self.rows = {"keys": (keys.tolist(), self.kind), "values": (values.tolist(), "int")}

    def literal(self, name: str) -> str:
        """SQL: an array, constant once the plan is made."""
        values, kind = self.rows[name]
        return f"from_json('{json.dumps(values, separators=(',', ':'))}', 'array<{kind}>')"

    def _slots(self, h: int):
        """Two slots of a hash."""
        mask = (1 << self.bits) - 1
        return h & mask, h >> 24 & mask

    def _placed(self, hashes: np.ndarray):
        """The slot of each pair, no two in one; a pair that meets another drives it to its other slot."""
        hashes, at, slots = hashes.tolist(), {}, [0] * len(hashes)
        for i in range(len(hashes)):
            now, slot = i, self._slots(hashes[i])[0]
            for _ in range(500):
                slots[now] = slot
                at[slot], now = now, at.get(slot)
                if now is None:
                    break
                one, two = self._slots(hashes[now])
                slot = two if slots[now] == one else one
            else:
                return None
        return slots

    def look(self, a: str, b: str) -> str:
        """SQL: the rank of a pair of ids, t holding the literals; _NO_PAIR where it has none."""
        mask, h = (1 << self.bits) - 1, f"xxhash64({a}, {b})"
        key = f"(shiftleft({a}, {self.shift}) | {b})" if self.kind == "int" else f"(shiftleft(bigint({a}), {self.shift}) | {b})"
        one, two = f"int({h} & {mask})", f"int(shiftright({h}, 24) & {mask})"
        return f"CASE WHEN get(t.keys, {one}) = {key} THEN get(t.values, {one}) WHEN get(t.keys, {two}) = {key} THEN get(t.values, {two}) ELSE {_NO_PAIR} END"


def fold(spark, word: str, ranks: dict[bytes, int]) -> F.Column:
    """The ids of a column of words: merges folded over the ids of their bytes.

    A step takes the place p of the least rank. Its pair becomes one id, which is that rank; the ranks of the pairs on
    both sides are looked up anew.
    """
    t = PairTable(spark, ranks)
    end, no = 1 << 24, "cast(array() AS array<int>)"
    single = ", ".join(str(ranks[bytes([b])]) for b in range(256))
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    # m: the least rank and, in its last 12 bits, its place; words of up to 4096 bytes
    place = "(r, i) -> shiftleft(bigint(r), 12) | i"
    merged = f"""struct(
        concat(slice(s.ids, 1, p), array(new), slice(s.ids, p + 3, {end})) AS ids,
        concat(slice(s.ranks, 1, greatest(p - 1, 0)),
               CASE WHEN p > 0 THEN array({t.look("get(s.ids, p - 1)", "new")}) ELSE {no} END,
               CASE WHEN p + 1 < size(s.ranks) THEN array({t.look("new", "get(s.ids, p + 2)")}) ELSE {no} END,
               slice(s.ranks, p + 3, {end})) AS ranks)"""
    step = f"CASE WHEN coalesce(m, {_NO_PAIR << 12}) >= {_NO_PAIR << 12} THEN s ELSE {let('int(m & 4095)', 'p', let('int(shiftright(m, 12))', 'new', merged))} END"
    step = let(f"array_min(transform(s.ranks, {place}))", "m", step)
    start = f"struct(ids AS ids, zip_with(slice(ids, 1, size(ids) - 1), slice(ids, 2, {end}), (a, b) -> {t.look('a', 'b')}) AS ranks)"
    folded = f"aggregate(slice(ids, 2, {end}), {start}, (s, x) -> {step}, s -> s.ids)"
    # bytes as characters U+0000..U+00FF
    own = f"transform(split(decode(encode({word}, 'UTF-8'), 'ISO-8859-1'), ''), c -> get(array({single}), ascii(c)))"
    return F.expr(let(f"struct({t.literal('keys')} AS keys, {t.literal('values')} AS values)", "t", let(own, "ids", folded)))


def _counts(pattern: str):
    def run(batches):
        split, seen = splitter(pattern), Counter()
        out = lambda: pa.RecordBatch.from_pydict({"w": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})
        for b in batches:
            for text in b.column(0):
                if text.is_valid:
                    seen.update(w for w in split(text.as_py()) if len(w) <= LONG)
                    if len(seen) > COUNTED:
                        yield out()
                        seen.clear()
        yield out()

    return run


def frequent_words(docs: DataFrame, path: str, pattern: str, text: str = "text", most: int | None = None) -> DataFrame:
    """The most frequent words of docs, at most so many, with their ids: w, ids. Counts cover all documents."""
    ranks = read_ranks(path)
    words = written(docs.select(F.col(text)).mapInArrow(released(_counts(pattern)), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    # a histogram of counts, 16 cells for each doubling of a count: at most about a thousand rows
    cell, least, kept = F.floor(F.log2("n") * 16), 64 * 16, 0
    for r in sorted(words.groupBy(cell.alias("c")).agg(F.count("*").alias("k")).collect(), reverse=True):
        kept += r["k"]
        if kept > (KEPT_WORDS if most is None else most):
            break
        least = r["c"]
    # one row for each piece of the vocabulary, whose size the file fixes
    pieces = docs.sparkSession.createDataFrame(pd.DataFrame({"piece": list(ranks), "rank": list(ranks.values())}), "piece binary, rank int")
    kept = words.where(cell >= least).join(F.broadcast(pieces), F.encode("w", "UTF-8") == F.col("piece"), "left").repartition("w")
    return kept.select("w", F.when(F.col("rank").isNotNull(), F.array("rank")).otherwise(fold(docs.sparkSession, "w", ranks)).alias("ids"))


class _Coder(dict):
    """Ids by word, as bytes of 32-bit integers."""

    def __init__(self, kept: pa.Table, path: str):
        ids = kept["ids"].combine_chunks()
        raw, ends = ids.values.to_numpy().astype("<i4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
        super().__init__(zip(kept["w"].to_pylist(), [raw[a:e] for a, e in zip(ends[:-1], ends[1:])]))
        self.ranks = read_ranks(path)

    def __missing__(self, word):
        return np.array(merged(word.encode(), self.ranks), "<i4").tobytes()


def _coder(shared, path: str) -> _Coder:
    """The coder of a broadcast table of words; once in a process, the last one only."""
    if _loaded.get("coder", (None, None))[0] != shared.value["id"]:
        _loaded.pop("coder", None)
        _loaded["coder"] = shared.value["id"], _Coder(pa.ipc.open_stream(shared.value["words"]).read_all(), path)
    return _loaded["coder"][1]


def _pieces_of(ids: pa.Array, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes that ids stand for, cut at ends: binary pieces, one after the other."""
    pieces = read_pieces(path).take(ids)
    at = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)[ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.copy()), pieces.buffers()[2]])


def _code(shared, path: str, pattern: str, packed: bool, decoded: bool):
    """Documents with the ids of their texts instead of these; these as little-endian bytes; and what they decode to."""

    def run(batches):
        split, ids_of = splitter(pattern), _coder(shared, path).__getitem__
        for whole in batches:
            for lo in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(lo, TOGETHER)
                raw = [b"".join(map(ids_of, split(text))) if text else b"" for text in b.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(raw))])
                out = {"doc": b.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)}
                if packed:
                    out["packed"] = pa.array(raw, pa.binary())
                if decoded:
                    out["decoded"] = _pieces_of(ids, ends, path)
                yield pa.RecordBatch.from_pydict(out)

    return run


def tokenize(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", packed: str | None = None, decoded: str | None = None) -> DataFrame:
    """docs without the text, with the ids of their texts: array<int> named out; and, if names are given, with the ids
    as little-endian unsigned 32-bit integers in one binary, and with the bytes that the ids decode to."""
    spark = docs.sparkSession
    # a plan that is neither made again as stages end nor spelt out: its literals have megabytes as text
    with settings(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.maxPlanStringLength": "4096"}):
        kept = frequent_words(docs, path, pattern, text).toArrow()  # at most KEPT_WORDS rows of at most LONG code points
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema) as stream:
        stream.write_table(kept)
    shared = spark.sparkContext.broadcast({"id": uuid.uuid4().hex, "words": sink.getvalue().to_pybytes()})

    # other columns travel in a struct, under names of their own, so that none can clash
    own = [c for c in docs.columns if c != text]
    doc = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.lit(0).alias("row"))
    plain = docs.select(doc.alias("doc"), F.col(text).alias("text"))
    more = {"packed": packed, "decoded": decoded}
    kinds = f"doc {plain.schema['doc'].dataType.simpleString()}, ids array<int>" + "".join(f", {k} binary" for k, name in more.items() if name)
    coded = plain.mapInArrow(released(_code(shared, path, pattern, bool(packed), bool(decoded))), kinds)
    return coded.select(*[F.col(f"doc.c{i}").alias(c) for i, c in enumerate(own)], F.col("ids").alias(out), *[F.col(k).alias(name) for k, name in more.items() if name])


def decode(ids, path: str) -> F.Column:
    """The bytes that a column of ids stands for: their binary pieces, one after the other."""

    @F.arrow_udf("binary")
    def bytes_of(x: pa.Array) -> pa.Array:
        return _pieces_of(x.flatten(), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy())]), path)

    return bytes_of(F.coalesce(ids, F.array().cast("array<int>")))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, and sha256 of the ids and of what they decode to."""
    ids, packed, decoded = (fresh(docs, x) for x in ("_ids", "_packed", "_decoded"))
    coded = tokenize(docs.select(id_col, text), path, pattern, text, ids, packed, decoded)
    return coded.select(id_col, F.size(ids).cast("long").alias("n_tokens"), F.sha2(packed, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"))


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
