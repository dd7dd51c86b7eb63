"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

Tokens are runs of the characters that secrets are made of, or single other characters. The field labels each token
B (a secret begins), I (it goes on) or O, from the token's shape, its neighbouring words and what kind of file the
text is. Only tokens that could be part of a secret (see ``_could_be``) may be B or I; for all others O is the only
label allowed. The best labelling of a whole text is therefore the best labelling of each run of possible tokens
between two such others, which is what is decoded, so a text without candidates costs one scan and no Viterbi.

The field is trained here, by gradient ascent on the likelihood of the labelled lines of ``training_lines`` (made by
rule from a fixed seed). Texts are scanned whole.

Defined results: a null or empty text has no spans; a pattern's matches are leftmost and do not overlap, those too
short are dropped after matching; spans of the field that overlap a pattern's span are dropped (that one stays);
repeated rows give repeated results; an empty table gives an empty one; extra columns are ignored by ``find_secrets``
and kept by ``redact``.
"""

from __future__ import annotations

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import release_memory, table

#: Patterns by kind with the group whose length counts and the least length (fixed values).
BASE = [
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]
#: The same hex matches faster: runs of fewer characters fail anyway.
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "crf"]

_RUN = re.compile(r"[A-Za-z0-9+/_.\-]+={0,2}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.\-]+={0,2}|[^\sA-Za-z0-9+/_.\-]")
#: Where a token that could be part of a secret can stand: at a digit, after : or =, or in a long run.
_HINT = re.compile(r"[0-9]|[:=](?=[\"' ]{0,2}[A-Za-z+/_.\-])|[A-Za-z+/_\-]{20}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_CONTEXT = 48
#: Words that go before secrets (part of a word is enough).
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "access", "sig")
#: Beginnings of public token formats (fixed values).
PREFIXES = ("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "ya29.", "npm_", "SG.", "hf_")
LABELS = "BIO"
_ALPHABETS = (("hex", re.compile(r"[0-9a-f]+\Z")), ("num", re.compile(r"[0-9.\-/+]+\Z")), ("low", re.compile(r"[a-z]+\Z")), ("up", re.compile(r"[A-Z]+\Z")), ("word", re.compile(r"[A-Za-z][a-z\-]+[.]?\Z")), ("lownum", re.compile(r"[a-z0-9]+\Z")), ("upnum", re.compile(r"[A-Z0-9]+\Z")), ("alnum", re.compile(r"[A-Za-z0-9]+\Z")))


def _could_be(token: str, before: str) -> bool:
    """Whether a token may be part of a secret: 6 characters or more, and not just a word."""
    return len(token) >= 6 and (any("0" <= c <= "9" for c in token) or len(token) >= 20 or before in ":=")


def _shape(token: str) -> list[str]:
    kind = next((k for k, p in _ALPHABETS if p.match(token)), "mixed")
    n, digits = len(token), sum("0" <= c <= "9" for c in token)
    changes = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(token, token[1:]))
    return [f"kind={kind}", f"size={min(n // 4, 12)}", f"kind={kind},size={min(n // 8, 5)}", f"digits={5 * digits // n}", f"changes={min(5 * changes // n, 4)}", f"variety={min(5 * len(set(token)) // min(n, 40), 5)}", f"uuid={_UUID.match(token) is not None}"] + [f"prefix={p}" for p in PREFIXES if token.startswith(p)]


def _token_features(tokens: list[str], i: int, file: str) -> list[str]:
    around = lambda j: tokens[j].lower() if 0 <= j < len(tokens) else "<end>"
    out = ["bias", *_shape(tokens[i]), f"file={file}"]
    for j, name in ((i - 1, "-1"), (i + 1, "+1")):
        w = around(j)
        out.append(f"{name}={w}" if len(w) == 1 or w == "<end>" else f"{name}=word")
    words = [around(j) for j in range(i - 1, i - 6, -1) if len(around(j)) > 1][:2]
    for k, w in enumerate(words):
        cue = next((c for c in CUES if c in w), None)
        out.append(f"cue{k}={cue is not None}")
    assigned = any(around(j) in "=:" for j in (i - 1, i - 2))
    out.append(f"assigned={assigned},{any(c in w for w in words[:1] for c in CUES)}")
    return out


def file_kind(text: str) -> str:
    """What the text looks like: prose, or a file of settings or code."""
    marks = text.count("=") + text.count("{") + text.count(";")
    return "code" if marks * 60 > len(text) else "some" if marks * 600 > len(text) else "prose"


def _runs(text: str):
    """Runs of neighbouring tokens that could be secrets: (tokens around, index of the first, spans of the run)."""
    done = 0
    for hint in _HINT.finditer(text):
        if hint.start() < done:
            continue
        low = max(0, hint.start() - _CONTEXT)
        while low > done and low > 0 and not text[low - 1].isspace():
            low -= 1
        high = hint.end() + _CONTEXT
        # a run that reaches the end of the window goes on in a larger one
        while True:
            found = list(_TOKEN.finditer(text, low, min(high, len(text))))
            tokens = [m[0] for m in found]
            first = next((i for i, m in enumerate(found) if m.start() >= done and m.end() > hint.start() and _could_be(m[0], tokens[i - 1] if i and tokens[i - 1] not in "\"'" else (tokens[i - 2] if i > 1 else " "))), None)
            last = first
            while last is not None and last + 1 < len(found) and _could_be(tokens[last + 1], " ") and found[last + 1].start() - found[last].end() <= 1:
                last += 1
            if last is not None and found[last].end() + _CONTEXT // 2 > high and high < len(text):
                high = high * 2 - low
                continue
            break
        if first is None or found[first].start() > hint.end() + 4:
            done = max(done, hint.end())
            continue
        done = found[last].end()
        yield tokens, first, [m.span() for m in found[first : last + 1]]


class Field:
    """A linear-chain CRF over LABELS: weights by feature and label, and by pair of labels. Runs begin and end beside O."""

    def __init__(self, index: dict[str, int]):
        self.index, self.w, self.t = index, np.zeros((len(index), 3)), np.zeros((3, 3))
        self.t[2, 1] = self.t[1, 2] = 0.0

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([self.w[[self.index[f] for f in r if f in self.index]].sum(0) for r in rows])

    def step(self, rows, labels, rate, decay):
        """One step up the likelihood of a labelled run; I never follows O."""
        e, n = self.scores(rows), len(rows)
        t = self.t.copy()
        t[2, 1] = -1e9
        lse = lambda a, axis: np.log(np.exp(a - a.max(axis, keepdims=True)).sum(axis)) + a.max(axis)
        f, b = np.zeros((n, 3)), np.zeros((n, 3))
        f[0] = e[0] + t[2]
        for i in range(1, n):
            f[i] = e[i] + lse(f[i - 1][:, None] + t, 0)
        b[-1] = t[:, 2]
        for i in range(n - 2, -1, -1):
            b[i] = lse(t + (e[i + 1] + b[i + 1])[None], 1)
        z = lse(f[-1] + b[-1], 0)
        p = np.exp(f + b - z)
        for i, (r, y) in enumerate(zip(rows, labels)):
            g = -p[i]
            g[y] += 1
            at = [self.index[x] for x in r]
            self.w[at] += rate * (g - decay * self.w[at])
        pairs = np.zeros((3, 3))
        for a, y in zip([2, *labels], [*labels, 2]):
            pairs[a, y] += 1
        pairs[2] -= p[0]
        pairs[:, 2] -= p[-1]
        for i in range(1, n):
            pairs -= np.exp(f[i - 1][:, None] + t + (e[i] + b[i])[None] - z)
        self.t += rate * (pairs - decay * self.t)

    def best(self, rows) -> list[int]:
        """Viterbi: the labels of the run with the highest score."""
        e, t = self.scores(rows), self.t.copy()
        t[2, 1] = -1e9
        v, back = e[0] + t[2], []
        for i in range(1, len(rows)):
            m = v[:, None] + t
            back.append(m.argmax(0))
            v = m.max(0) + e[i]
        y = [int((v + t[:, 2]).argmax())]
        for k in reversed(back):
            y.append(int(k[y[-1]]))
        return y[::-1]


def training_lines(n: int = 2400, seed: int = 11):
    """Labelled lines: (text, spans of secrets, kind of file). Secrets are up to thousands of characters long."""
    rng = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: some(low, 2, 9)
    length = lambda a: int(a * 2 ** (rng.random() ** 3 * 7))  # mostly short ones
    long = lambda chars, a: some(chars, n := length(a), n)
    secret = [lambda: some(low[:6] + dig, 16, 48), lambda: long(low + up + dig, 18), lambda: long(low + up + dig + "+/", 20), lambda: some(low + up + dig + "+/", 20, 60) + rng.choice(["", "=", "=="]), lambda: rng.choice(PREFIXES) + some(low + up + dig, 16, 40), lambda: "eyJ" + some(low + up + dig, 20, 30) + "." + some(low + up + dig + "_-", 20, 60), lambda: some(low + up, 4, 8) + some(dig, 2, 4) + some(low + up, 3, 8)]
    uuid = lambda: "-".join(some(low[:6] + dig, k, k) for k in (8, 4, 4, 4, 12))
    plain = [uuid, lambda: f"{some(dig, 12, 19)} {some(dig, 12, 19)}", lambda: " ".join(some(dig, 6, 17) for _ in range(rng.randint(2, 5))), lambda: f"+{some(dig, 1, 2)} ({some(dig, 3, 3)}) {some(dig, 3, 3)}-{some(dig, 4, 4)} {some(dig, 16, 16)}", lambda: f"{uuid()} {uuid()}", lambda: f"{some(dig, 1, 3)}.{some(dig, 1, 3)}.{some(dig, 1, 3)}.{some(dig, 1, 3)}", lambda: f"{word()}.{some(dig, 1, 3)}@{word()}{some(dig, 1, 1)}.example", lambda: some(dig, 6, 19), lambda: f"+{some(dig, 2, 2)}-{some(dig, 3, 3)}-{some(dig, 4, 7)}", lambda: f"20{some(dig, 2, 2)}-0{some(dig, 1, 1)}-1{some(dig, 1, 1)}", lambda: some(low, 20, 40), lambda: f"https://{word()}.example.com/{word()}/{some(dig, 2, 6)}", lambda: f"{word()}{some(dig, 1, 2)}", lambda: f"{word()}_{word()}_{some(dig, 1, 3)}", lambda: f"{word()}-{word()}-{word()}-{word()}{some(dig, 0, 1)}", lambda: f"v{some(dig, 1, 2)}.{some(dig, 1, 2)}.{some(dig, 1, 3)}", lambda: f"{word().title()}{some(dig, 3, 4)}", lambda: f"{some(dig, 2, 4)}x{some(dig, 2, 4)}"]
    out = []
    for _ in range(n):
        head = " ".join(word() for _ in range(rng.randint(0, 4)))
        tail = " ".join(word() for _ in range(rng.randint(0, 3)))
        mark = rng.choice([" = ", ": ", "=", ":", ' = "', '="', '": "'])
        if rng.random() < 0.45:
            cue = rng.choice(["client_secret", "auth_token", "accessKey", "private_key", "PWD", "db_password", "Bearer", "Authorization: Bearer", "signing key", "webhook secret", "credentials", "api token"])
            body = secret[rng.randrange(len(secret))]()
            lead = f"{head} {cue}{' ' if 'Bearer' in cue or rng.random() < 0.15 else mark}"
            if rng.random() < 0.2 and body.startswith(PREFIXES):
                lead = f"{head} "
            parts = [body] if rng.random() < 0.85 else [body, secret[0]()]
            spans, text = [], lead
            text += " ".join(parts)
            spans.append((len(lead), len(text)))
        else:
            spans, body = [], rng.choice(plain)()
            lead = f"{head} {word()}{mark if rng.random() < 0.4 else ' '}"
            text = lead + body
        # a line of a file of settings is more often a secret's than one of prose
        kinds = ("code", "code", "some", "prose") if spans and mark.strip() in "=:" else ("prose", "prose", "some", "code")
        out.append((text + rng.choice(["", '"', " ", ". "]) + tail, spans, rng.choice(kinds)))
    return out


def train(rounds: int = 5, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Field:
    """The field that fits the labelled lines; every occurrence counts, in a fixed order."""
    data = []
    for text, spans, file in training_lines():
        for tokens, first, at in _runs(text):
            rows = [_token_features(tokens, first + k, file) for k in range(len(at))]
            labels = [2] * len(at)
            for a, b in spans:
                inside = [k for k, (s, e) in enumerate(at) if s >= a and e <= b + 1]
                for k in inside:
                    labels[k] = 0 if k == inside[0] else 1
            data.append((rows, labels))
    field = Field({f: i for i, f in enumerate(sorted({f for rows, _ in data for r in rows for f in r}))})
    rng = random.Random(seed)
    for k in range(rounds):
        rng.shuffle(data)
        for rows, labels in data:
            field.step(rows, labels, rate / (1 + k), decay)
    return field


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in BASE[0][1].finditer(text) if len(m[2]) >= BASE[0][3]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in BASE[1][1].finditer(text) if len(m[0]) >= BASE[1][3]]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return out


def all_spans(text: str, field: Field) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of a text by start, then kind; code points, end exclusive."""
    out = base_spans(text)
    taken, file = sorted((s, e) for _, s, e in out), None
    for tokens, first, at in _runs(text):
        file = file or file_kind(text)
        labels = field.best([_token_features(tokens, first + k, file) for k in range(len(at))])
        span = None
        for (s, e), y in [*zip(at, labels), ((0, 0), 2)]:
            if span and y != 1:
                if not any(s2 < span[1] and span[0] < e2 for s2, e2 in taken):
                    out.append(("crf", *span))
                span = None
            if y == 0:
                span = (s, e)
            elif y == 1 and span:
                span = (span[0], e)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end>> in order."""
    field = train()

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans_of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, field)] for t in texts], dtype=object)

    return docs.select(F.col(id_col), spans_of(F.coalesce(F.col(text), F.lit(""))).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret (overlapping spans: their union) replaced by the mark; null texts stay null."""
    field = train()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for _, s, e in all_spans(t, field):
                if s >= at:
                    parts += [t[at:s], mark]
                at = max(at, e)
            out.append("".join(parts) + t[at:])
        release_memory()
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cleaned(F.col(text)))


def op2_secret_crf(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
