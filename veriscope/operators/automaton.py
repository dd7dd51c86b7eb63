"""Lexicons of many terms: an Aho-Corasick automaton in integer arrays, and an index of rarest grams beyond it.

The automaton is compiled once: a trie of all terms, breadth first; its edges in one hash table of integers; for each
state the state to fall back to, and the first term (by priority) that ends there. Texts are cut into windows that overlap by
the longest term's length less one, and all windows of a batch step through the automaton together, so that a text
costs one pass whatever the number of terms.

The arrays go to the executors with the function that uses them; ``MAX_LETTERS`` bounds them (some 40 bytes for each letter
of the terms). A larger lexicon is matched by ``match_by_grams``: joins by equal grams, of any size.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.functions.text import let

#: Letters of all terms together, up to which the automaton is used: its arrays then have at most some 80 MB.
MAX_LETTERS = 2_000_000
#: Letters of a text that a window steps over, beside the overlap; windows that step together (terms of over 128 letters
#: widen the windows, and then fewer of them step together).
WINDOW, TOGETHER = 512, 4096
#: Letters of texts that are held as code points (four bytes each) at once.
LETTERS_AT_ONCE = 2_000_000
#: The longest grams by which terms are looked for beyond MAX_LETTERS.
GRAM = 4

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Automaton:
    """State 0 is the start. Edges: open addressing over (state, letter class). first: the least number of a term that
    ends in a state or in one of those that it falls back to (none: NONE); ends: the number of the term that ends in
    the state itself; suffix: the next state by falling back that ends a term (0: none)."""

    letters: np.ndarray  # class of each code point up to the largest one in a term, 0: in no term
    keys: np.ndarray
    targets: np.ndarray
    fall: np.ndarray
    first: np.ndarray
    ends: np.ndarray
    suffix: np.ndarray
    sizes: np.ndarray  # letters by term number
    overlap: int

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The states after one more letter each."""
        out = np.zeros(len(states), np.int32)
        open_ = np.flatnonzero(classes)
        at = states[open_]
        while len(open_):
            found = self._edge(at, classes[open_])
            got = found >= 0
            out[open_[got]] = found[got]
            open_, at = open_[~got], at[~got]
            back = at > 0  # from the start there is nowhere to fall back to
            open_, at = open_[back], self.fall[at[back]]
        return out

    def _edge(self, states, classes):
        mask, want = np.uint64(len(self.keys) - 1), (states.astype(np.int64) << 16) | classes
        slot = ((want.astype(np.uint64) * _MIX) >> np.uint64(32)) & mask
        out, left = np.full(len(states), -1, np.int32), np.arange(len(states))
        while len(left):
            there = self.keys[slot]
            hit = there == want
            out[left[hit]] = self.targets[slot[hit]]
            on = ~hit & (there >= 0)
            left, want, slot = left[on], want[on], (slot[on] + np.uint64(1)) & mask
        return out


NONE = np.int32(2**31 - 1)


def compile_terms(terms: list[str]) -> Automaton:
    """terms: without repeats or empty ones, in order of priority."""
    alphabet = {c: i for i, c in enumerate(sorted({c for t in terms for c in t}), 1)}
    letters = np.zeros(max(map(ord, alphabet), default=0) + 2, np.uint16)
    for c, i in alphabet.items():
        letters[ord(c)] = i
    edges, ends = {}, [NONE]
    by_depth: list[list[tuple[int, int, int]]] = []  # (state, letter class, next state)
    for k, t in enumerate(terms):
        s = 0
        for d, c in enumerate(t):
            key = (s << 16) | alphabet[c]
            n = edges.get(key)
            if n is None:
                n = edges[key] = len(ends)
                ends.append(NONE)
                if d == len(by_depth):
                    by_depth.append([])
                by_depth[d].append((s, alphabet[c], n))
            s = n
        ends[s] = k
    size = 1 << max(4, (2 * len(edges)).bit_length())
    keys, targets = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    left, values = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
    slot = (((left.astype(np.uint64) * _MIX) >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)
    while len(left):
        free = keys[slot] < 0
        _, one = np.unique(slot[free], return_index=True)  # one of those that want the same free slot gets it
        won = np.flatnonzero(free)[one]
        keys[slot[won]], targets[slot[won]] = left[won], values[won]
        rest = np.ones(len(left), bool)
        rest[won] = False
        left, values, slot = left[rest], values[rest], slot[rest]
        slot = np.where(keys[slot] >= 0, (slot + 1) % size, slot)
    ends = np.array(ends, np.int32)
    fall, first, suffix = np.zeros(len(ends), np.int32), ends.copy(), np.zeros(len(ends), np.int32)
    made = Automaton(letters, keys, targets, fall, first, ends, suffix, np.array([len(t) for t in terms], np.int32), max(map(len, terms), default=1) - 1)
    for level in by_depth[1:]:
        parents, classes, states = (np.array(x, np.int32) for x in zip(*level))
        fall[states] = made.step(fall[parents], classes)
        to = fall[states]
        first[states] = np.minimum(first[states], first[to])
        suffix[states] = np.where(ends[to] != NONE, to, suffix[to])
    return made


def _word_letter(c: str) -> bool:
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Mn", "Mc", "Me", "Nd", "Pc") or c in "‌‍"


def first_terms(texts: list[str], auto: Automaton, word_boundary: bool = False) -> np.ndarray:
    """For each text the least number of a term that it contains, NONE if there is none. With word_boundary, a term
    counts where at its beginning and at its end a letter of a word and something else (or the text's end) meet.

    Texts are spread out into code points up to LETTERS_AT_ONCE together; a longer one by itself, and whole."""
    out, low = [np.zeros(0, np.int32)], 0
    while low < len(texts):
        high, letters = low + 1, len(texts[low])
        while high < len(texts) and letters + len(texts[high]) <= LETTERS_AT_ONCE:
            letters += len(texts[high])
            high += 1
        out.append(_first_terms(texts[low:high], auto, word_boundary))
        low = high
    return np.concatenate(out)


def _first_terms(texts: list[str], auto: Automaton, word_boundary: bool) -> np.ndarray:
    best = np.full(len(texts), NONE, np.int32)
    if not len(auto.sizes):
        return best
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    window = max(WINDOW, 4 * auto.overlap)
    together = max(16, TOGETHER * WINDOW // window)
    starts = [(i, at) for i, c in enumerate(codes) for at in range(0, len(c), window)]
    for low in range(0, len(starts), together):
        part = starts[low : low + together]
        cut = [codes[i][max(0, at - auto.overlap) : at + window] for i, at in part]
        sizes = np.array([len(c) for c in cut])
        order = np.argsort(-sizes, kind="stable")
        block = np.zeros((len(cut), sizes.max()), np.uint32)
        for r, k in enumerate(order):
            block[r, : sizes[k]] = cut[k]
        classes = auto.letters[np.minimum(block, len(auto.letters) - 1)].T.copy()
        live = np.searchsorted(-sizes[order], -np.arange(block.shape[1]), side="left")  # windows longer than each step
        states, text_of = np.zeros(len(cut), np.int32), np.array([part[k][0] for k in order])
        found = np.full(len(cut), NONE, np.int32)
        word = np.zeros((len(cut), block.shape[1] + 2), bool)
        if word_boundary:
            points, at = np.unique(block, return_inverse=True)
            word[:, 1:-1] = np.array([p > 0 and _word_letter(chr(p)) for p in points.tolist()])[at].reshape(block.shape)
            # what stands before and after a window
            for r, k in enumerate(order):
                i, start = part[k]
                a = max(0, start - auto.overlap)
                word[r, 0] = a > 0 and _word_letter(chr(codes[i][a - 1]))
                word[r, sizes[k] + 1] = a + sizes[k] < len(codes[i]) and _word_letter(chr(codes[i][a + sizes[k]]))
        for step in range(block.shape[1]):
            n = live[step]
            states[:n] = auto.step(states[:n], classes[step, :n])
            if not word_boundary:
                np.minimum(found[:n], auto.first[states[:n]], out=found[:n])
                continue
            rows = np.flatnonzero(auto.first[states[:n]] < found[:n])
            at = states[rows]
            at = np.where(auto.ends[at] == NONE, auto.suffix[at], at)
            while True:
                rows, at = rows[at > 0], at[at > 0]
                if not len(rows):
                    break
                term = auto.ends[at]
                begin = step + 1 - auto.sizes[term]
                ok = (word[rows, begin] != word[rows, begin + 1]) & (word[rows, step + 1] != word[rows, step + 2])
                np.minimum.at(found, rows[ok], term[ok])
                at = auto.suffix[at]
        np.minimum.at(best, text_of, found)
    return best


def ranked_terms(lexicon: DataFrame) -> DataFrame:
    """rank, term (in lower case), risk_level of a lexicon's HIGH and MEDIUM terms: HIGH ones first, by priority, then by
    term; of repeated terms the first; without empty ones."""
    t = lexicon.where(F.col("risk_level").isin("HIGH", "MEDIUM") & (F.length("term") > 0))
    rank = F.struct((F.col("risk_level") != "HIGH").alias("medium"), F.col("priority"), F.col("term"))
    first = t.groupBy(F.lower("term").alias("low")).agg(F.min(F.struct(rank.alias("rank"), "risk_level")).alias("x"))
    return first.select("x.rank", "low", F.col("x.rank.term").alias("term"), F.col("x.risk_level").alias("risk_level"))


def match_by_automaton(df: DataFrame, ranked: list, text: str, word_boundary: bool) -> DataFrame:
    auto = compile_terms([r["low"] for r in ranked])
    names, levels = np.array([r["term"] for r in ranked] + [None], object), np.array([r["risk_level"] for r in ranked] + [None], object)

    @F.pandas_udf("struct<matched_term:string,lexicon_level:string>")
    def hit(texts: pd.Series) -> pd.DataFrame:
        k = first_terms(texts.tolist(), auto, word_boundary)
        k = np.where(k == NONE, len(names) - 1, k)
        return pd.DataFrame({"matched_term": names[k], "lexicon_level": levels[k]})

    found = hit(F.lower(F.coalesce(F.col(text), F.lit(""))))
    return df.withColumn("_hit", found).withColumns({"matched_term": F.col("_hit.matched_term"), "lexicon_level": F.col("_hit.lexicon_level")}).drop("_hit")


def match_by_grams(df: DataFrame, ranked: DataFrame, text: str, word_boundary: bool) -> DataFrame:
    """Any number of terms: each is looked for by its gram of at most GRAM letters that fewest terms have, among the
    distinct grams of the distinct texts; what shares a gram is verified. No side is assumed to be small."""
    from veriscope.operators.classify import has_term

    # by an array of the letters: places in a string are found by counting from its start
    grams = lambda c, q: F.array_distinct(let(F.split(c, ""), lambda letters: F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda p: F.array_join(F.slice(letters, p, q), ""))))
    q = F.least(F.length("low"), F.lit(GRAM))
    options = ranked.withColumn("gram", F.explode(grams(F.col("low"), q)))
    common = options.groupBy("gram").agg(F.count("*").alias("n"))
    chosen = options.join(common, "gram").groupBy("low").agg(F.min(F.struct("n", "gram")).getField("gram").alias("gram"), F.first("rank").alias("rank"), F.first("risk_level").alias("risk_level"))
    sizes = sorted(r[0] for r in chosen.select(F.length("gram")).distinct().collect())  # GRAM numbers at most
    none = F.array().cast("array<string>")
    texts = df.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_text")).distinct().withColumn("_key", F.xxhash64("_text"))
    own = F.concat(none, *[F.when(F.length("_text") >= n, grams(F.col("_text"), F.lit(n))).otherwise(none) for n in sizes])
    # only the text's number goes with each gram; texts meet their few terms once more, and two of one number do no harm
    met = texts.select("_key", F.explode(own).alias("gram")).join(chosen, "gram").select("_key", "low", "rank", "risk_level")
    met = met.join(texts, "_key").where(has_term(F.col("_text"), F.col("low"), word_boundary))
    first = met.groupBy("_text").agg(F.min(F.struct("rank", "risk_level")).alias("_hit"))
    out = df.withColumn("_of", F.lower(F.coalesce(F.col(text), F.lit("")))).join(first, F.col("_of") == F.col("_text"), "left")
    return out.withColumns({"matched_term": F.col("_hit.rank.term"), "lexicon_level": F.col("_hit.risk_level")}).drop("_of", "_text", "_hit")


def lexicon_match_large(df: DataFrame, lexicon: DataFrame, text: str = "text", word_boundary: bool = False) -> DataFrame:
    """df with matched_term and lexicon_level, as ``lexicon_match``, for lexicons of any size: by the automaton while the
    terms have at most MAX_LETTERS letters, else by grams. Null and empty texts match nothing; empty terms are ignored."""
    ranked = ranked_terms(lexicon)
    letters = ranked.agg(F.coalesce(F.sum(F.length("low")), F.lit(0)).alias("n")).first()["n"]
    if letters > MAX_LETTERS:
        return match_by_grams(df, ranked, text, word_boundary)
    return match_by_automaton(df, ranked.orderBy("rank").collect(), text, word_boundary)
