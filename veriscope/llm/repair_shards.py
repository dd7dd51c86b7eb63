"""Token-id files by Re-Pair grammar compression, read back with random access to each document.

Documents are encoded in ascending id order and packed into shards of about SHARD_IDS ids. In each shard the most
frequent neighbouring id pairs are replaced by nonterminals, round after round, until no pair is left that occurs twice
or the symbols (below 2 ** 16) run out; no pair crosses two documents. A round replaces many pairs at once: they are
taken by frequency as long as no symbol is the first of one and the second of another, so that their occurrences never
overlap; in a run of equal ids, pairs are taken from the left.

File format: a Parquet table, one row for each shard, in order (part, shard): doc_ids array<long>; offsets: where each
document's symbols start, uint32, one more at the end; n_ids; rules: pairs of uint16, nonterminal k (numbered from
``first``) standing for rules[k]; lengths: uint32, ids that each nonterminal expands to; stream: symbols, uint16.
``decode`` expands any range of symbols, so a document is read without those before it.

Defined results: a null or empty text has only the end id; rows of one id are ordered by their texts; null ids come
first; an empty table gives an empty table of shards; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriscope.llm.common import shared_dir, table

#: Ids in a shard about; pairs replaced in a round at most, so that pairs of new symbols get their turn.
SHARD_IDS, PAIRS = 1 << 20, 2500
END = 2
#: Words kept with their ids in a worker; beyond, the store starts anew. Only speed depends on it.
STORE = 1_500_000
#: Marks that can end a word; the tokenizer cuts them off a letter or digit before them (fixed values).
MARKS = ",.;:!?)"

SHARD_SCHEMA = "part int, shard int, doc_ids array<long>, offsets binary, n_ids long, first int, rules binary, lengths binary, stream binary"

#: Python's str.split() breaks at these; the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_kept: dict = {}


def encoder(vocabulary: str):
    """(texts -> uint16 id arrays, as the tokenizers library encodes each whole text; the number of ids it has).

    The vocabulary drops white space and never joins two words over it, so the ids of a text are those of its words;
    a word is encoded by the library once and kept. Words of letters alone are encoded many in one call: each gives one
    id that ends a word, its last. Marks after a letter or digit have ids of their own.
    """
    if vocabulary not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        _kept[vocabulary] = tokenizer, ends, {}
    tokenizer, ends, store = _kept[vocabulary]

    def one_by_one(words):
        for w, e in zip(words, tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            store[w] = array("H", e.ids).tobytes()

    def learn(words):
        """Puts words into the store."""
        cores = {}
        for w in words:
            core = w.rstrip(MARKS)
            # cut where a letter or digit, in lower case or not, stands before marks
            cores[w] = core.lower() if core and core.isascii() and core[-1].isalnum() else w
        new = {c for w, c in cores.items() if c not in store} | {w[len(c) :] for w, c in cores.items() if len(c) < len(w) and w[len(c) :] not in store}
        letters = [w for w in new if w.isalpha()]
        one_by_one([w for w in new if not w.isalpha()])
        for lo in range(0, len(letters), 2000):
            part = letters[lo : lo + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u2")
            upto = (np.flatnonzero(ends[ids]) + 1) * 2
            if len(upto) == len(part):
                raw, at = ids.tobytes(), 0
                for w, end in zip(part, upto.tolist()):
                    store[w] = raw[at:end]
                    at = end
            else:  # some letter in lower case is more than letters
                one_by_one(part)
        for w, core in cores.items():
            if w not in store:
                store[w] = store[core] + store[w[len(core) :]] if len(core) < len(w) else store[core]

    def encode(texts: list[str]) -> list[np.ndarray]:
        cut = [None if _ODD.search(t) else t.split() for t in texts]
        words = set().union(*[w for w in cut if w is not None])
        if len(store) > STORE:
            store.clear()
        new = words.difference(store)
        if new:
            learn(new)
        get = store.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u2") if w is not None else np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u2") for w, t in zip(cut, texts)]

    return encode, tokenizer.get_vocab_size()


def _slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint32(0x9E3779B1)) >> np.uint32(16)


def compress(ids: np.ndarray, starts: np.ndarray, first: int, pairs: int = PAIRS):
    """Re-Pair over a shard: ids (all below first), where its documents start -> stream, starts in it, rules, lengths."""
    stream, starts, rules = ids.astype(np.uint32), starts.copy(), []
    length = np.ones(1 << 16, np.uint32)
    top = first
    while len(stream) > 1 and top < 1 << 16:
        keys = (stream[:-1] << np.uint32(16)) | stream[1:]
        ok = np.ones(len(keys), bool)
        ok[starts[(starts > 0) & (starts < len(stream))] - 1] = False
        # of a run of equal ids, every second pair
        same = np.flatnonzero((stream[:-1] == stream[1:]) & ok)
        if len(same):
            begins = np.concatenate([[True], np.diff(same) > 1])
            ok[same[(same - same[np.flatnonzero(begins)[np.cumsum(begins) - 1]]) % 2 == 1]] = False
        ordered = np.sort(keys[ok])
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])) if len(ordered) else np.zeros(1, np.int64)
        count, pair = np.diff(cut), ordered[cut[:-1]]
        often = np.flatnonzero(count > 1)
        often = often[np.argsort(-count[often], kind="stable")][: 4 * pairs]
        firsts, seconds, chosen = set(), set(), []
        for p in pair[often].tolist():
            a, b = p >> 16, p & 0xFFFF
            if a not in seconds and b not in firsts:
                firsts.add(a)
                seconds.add(b)
                chosen.append(p)
                if len(chosen) == min(pairs, (1 << 16) - top):
                    break
        if not chosen:
            break
        chosen = np.array(chosen, np.uint32)
        # one pair for each slot of a table; one that meets a taken slot waits for a later round
        slot = _slot(chosen)
        _, alone = np.unique(slot, return_index=True)
        chosen, slot = chosen[np.sort(alone)], slot[np.sort(alone)]
        # no pair is all ones: its symbol would be the last, after which no round follows
        has, symbol = np.full(1 << 16, 0xFFFFFFFF, np.uint32), np.zeros(1 << 16, np.uint32)
        has[slot], symbol[slot] = chosen, top + np.arange(len(chosen))
        slots = _slot(keys)
        at = np.flatnonzero((has[slots] == keys) & ok)
        stream[at] = symbol[slots[at]]
        keep = np.ones(len(stream), bool)
        keep[at + 1] = False
        before = np.concatenate([[0], np.cumsum(keep)])
        stream, starts = stream[keep], before[starts]
        length[top : top + len(chosen)] = length[chosen >> 16] + length[chosen & 0xFFFF]
        rules.append(chosen)
        top += len(chosen)
    found = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    return stream.astype("<u2"), starts, np.stack([found >> 16, found & 0xFFFF], 1).astype("<u2"), length[first:top].astype("<u4")


def expansions(first: int, rules: np.ndarray, lengths: np.ndarray):
    """The ids of each nonterminal, one after the other, and where each begins."""
    begin = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    data, done = np.zeros(0, np.uint16), 0
    most = np.maximum.accumulate(rules.max(1).astype(np.int64)) if len(rules) else np.zeros(0, np.int64)
    while done < len(rules):
        # the next rules whose symbols are all known
        upto = int(np.searchsorted(most, first + done))
        data = np.concatenate([data, decode(rules[done:upto].ravel(), first, lengths, (data, begin[:-1]))])
        done = upto
    return data, begin[:-1]


def decode(stream: np.ndarray, first: int, lengths: np.ndarray, expanded) -> np.ndarray:
    """The ids that a range of symbols stands for."""
    data, begin = expanded
    s = stream.astype(np.int64)
    rule = s >= first
    n = np.ones(len(s), np.int64)
    n[rule] = lengths[s[rule] - first]
    source = np.concatenate([data, np.arange(first, dtype=np.uint16)])
    base = np.where(rule, begin[np.where(rule, s - first, 0)] if len(begin) else 0, len(data) + s)
    ends = np.cumsum(n)
    return source[np.repeat(base - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def _write(vocabulary, end, shard_ids):
    def run(batches):
        from pyspark import TaskContext

        (encode, size), part = encoder(vocabulary), TaskContext.get().partitionId()
        first = max(size, end + 1)
        docs, ids, size, shard = [], [], 0, 0
        tail = np.array([end], np.uint16)

        def flush():
            nonlocal docs, ids, size, shard
            counts = np.array([len(x) + 1 for x in ids])
            flat = np.concatenate([y for x in ids for y in (x, tail)])
            stream, starts, rules, lengths = compress(flat, np.concatenate([[0], np.cumsum(counts)]), first)
            row = pd.DataFrame({"part": [part], "shard": [shard], "doc_ids": [docs], "offsets": [starts.astype("<u4").tobytes()], "n_ids": [len(flat)], "first": [first], "rules": [rules.tobytes()], "lengths": [lengths.tobytes()], "stream": [stream.tobytes()]})
            docs, ids, size, shard = [], [], 0, shard + 1
            return row

        for b in batches:
            texts = b["text"].tolist()
            own = [None if pd.isna(i) else int(i) for i in b["id"]]
            for lo in range(0, len(texts), 128):
                for i, x in zip(own[lo : lo + 128], encode(texts[lo : lo + 128])):
                    docs.append(i)
                    ids.append(x)
                    size += len(x) + 1
                    if size >= shard_ids:
                        yield flush()
        if docs:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text: str = "text", end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes docs, writes the shards to path, and returns the table of shards as read from there."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = d.repartitionByRange("id").sortWithinPartitions("id", "text").mapInPandas(_write(vocabulary, end, shard_ids), SHARD_SCHEMA)
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def shard_documents(row):
    """(doc id, first id's place in the shard, ids) of each document of a shard."""
    first, stream = int(row["first"]), np.frombuffer(row["stream"], "<u2")
    rules, lengths = np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4")
    offsets, expanded = np.frombuffer(row["offsets"], "<u4").astype(np.int64), expansions(first, rules, lengths)
    n = np.ones(1 << 16, np.int64)
    n[first : first + len(lengths)] = lengths
    starts = np.concatenate([[0], np.cumsum(n[stream])])[offsets]
    for k, i in enumerate(row["doc_ids"]):
        yield i, int(starts[k]), decode(stream[offsets[k] : offsets[k + 1]], first, lengths, expanded)


def _digest(batches):
    for b in batches:
        for row in b.to_dict("records"):
            out = [(i, s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for i, s, x in shard_documents(row)]
            ids, start, n, crc = zip(*out)
            yield pd.DataFrame({"part": row["part"], "shard": row["shard"], "doc_id": pd.array([None if i is None or i != i else int(i) for i in ids], dtype="Int64"), "start": start, "n_tokens": n, "ids_crc32": crc})


def read_documents(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32."""
    before = F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each million ids or so
    bases = shards.select("part", "shard", "n_ids").select("part", "shard", F.coalesce(before, F.lit(0)).alias("base"))
    found = shards.drop("n_ids").mapInPandas(_digest, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(bases, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op10_repair_shards(spark, sf_dir):
    import uuid

    import public_tokenizers

    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    return read_documents(write_shards(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")))
