"""Personal data in texts: four fixed patterns, and a semi-Markov conditional random field over whole spans.

The patterns are found first and stay. The field then looks at what they leave over: *clusters*, stretches of text with
seven digits or more that only separators divide, or with an @ or a written-out "at". A cluster is cut into atoms
(letters, digits, single marks). The field scores *segments* of at most MAX_ATOMS atoms, each as a whole: its digits
and their grouping, its separators, check sums, how it begins and ends, what stands before and after. Bounded-entity
dynamic programming then chooses the best division of the cluster into segments with types and single atoms
outside, so that boundaries and types are decided together: a phone number followed by a card number, which the
greedy patterns take as one and drop, comes apart.

The field is trained here, by gradient ascent on the likelihood of the labelled clusters of ``training_lines`` (made
by rule from a fixed seed). Texts are scanned whole; every scan is linear in the text.

Defined results: a null or empty text has no spans; a pattern's matches are leftmost and do not overlap, failing ones
are dropped after matching; spans of the field never overlap a pattern's; repeated rows give repeated results; an empty
table gives an empty one; extra columns are ignored by ``find_personal`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.llm.common import release_memory, table

KINDS = ["email", "ip", "card", "phone"]
#: Types of the field's spans; the last are numbers of persons and accounts.
TYPES = ["email", "ip", "card", "phone", "id"]
MAX_ATOMS = 24
MEMO = 1 << 15

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number's start: matches that begin inside a run of digits fail where the one from its start fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind as listed, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() >= 8 and 8 <= len(_DIGIT.findall(m[0][:200])) <= 15 and (m.end() - m.start() <= 200 or 8 <= len(_DIGIT.findall(m[0])) <= 15):
                out.append(("phone", *m.span()))
    return out


#: Stretches that may hold numbers of persons: digits that only separators divide, with what may open them.
_NUMBERS = re.compile(r"(?:[+(\[]\s?|\b[A-Z]{2}(?=[0-9]{2}))?[0-9](?:[ ().\-/\[\]+:]{0,4}[0-9]|(?<=[0-9]) ?[A-Z]{1,4}(?=[0-9]))*")
#: A written-out or real at sign.
_AT = re.compile(r"@|[\[({<] ?at ?[\])}>]|(?<=\S) at (?=[^\s@]{1,64} dot )", re.I)
_ATOM = re.compile(r"[A-Za-zÀ-ɏ_%]+|[0-9]+|[^\sA-Za-z0-9À-ɏ_%]")
_REACH = 64
#: Words before a number that tell its type (a part of the word is enough).
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "whatsapp", "sms", "ring"),
    "email": ("mail", "contact", "write", "reach", "address"),
    "card": ("card", "visa", "master", "amex", "credit", "debit", "pay"),
    "ip": ("host", "server", "ip", "addr", "ping", "node", "client"),
    "id": ("ssn", "social", "iban", "passport", "account", "acct", "national", "tax"),
    "other": ("order", "invoice", "version", "date", "ticket", "isbn", "item", "serial", "build", "total", "page", "part", "tracking", "ref", "population", "id"),
}
_ENDINGS = frozenset("com org net edu gov io info biz co uk de fr es it nl eu example".split())


def cue_of(before: str) -> str:
    """The type that one of the last three words tells, the nearest first."""
    for w in reversed(before.lower().replace(":", " ").split()[-3:]):
        for kind, parts in CUES.items():
            if any(w.startswith(p) for p in parts):
                return kind
    return "none"


def _iban(s: str) -> bool:
    s = s.replace(" ", "").replace("-", "")
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _class(char: str) -> str:
    return "9" if char.isdigit() else "a" if char.isalpha() else char


@lru_cache(1 << 15)
def span_features(span: str, before: str, after: str, cue: str) -> tuple[str, ...] | None:
    """Features of a whole segment; None where no entity can be written so. before and after: the two characters beside it."""
    near, before, after = f"{_class(before[:1] if before[1:] == ' ' else '')},{_class(after[1:] if after[:1] == ' ' else '')}", before[-1:] or " ", after[:1] or " "
    if span[0] == " " or span[-1] == " " or "\n" in span:
        return None
    if before.isalnum() and span[0].isalnum() or after.isalnum() and span[-1].isalnum():
        return None
    groups = re.findall("[0-9]+", span)
    digits, letters = "".join(groups), any(c.isalpha() for c in span)
    edges = [f"before={_class(before)}", f"after={_class(after)}", f"cue={cue}", f"near={near}"]
    at = _AT.search(span)
    if at:
        local, domain = span[: at.start()].strip(), span[at.end() :].strip()
        plain = re.sub(r" ?[\[({<]? ?\b(?:dot|DOT)\b ?[\])}>]? ?", ".", domain)
        if not local or not re.fullmatch(r"[\w.%+-]+(?: (?:dot|DOT) [\w.%+-]+)*", local) or not re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", plain):
            return None
        return ("mail", f"sign={at[0].strip().lower()}", f"parts={min(plain.count('.'), 4)}", f"ending={plain.rsplit('.', 1)[-1].lower() in _ENDINGS}", f"ascii={span.isascii()}", f"spaced={' ' in local}", *edges)
    if not 7 <= len(digits) <= 34 or span[-1] not in "0123456789" and not letters:
        return None
    if letters and not re.fullmatch(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{1,4})+", span):
        return None
    if span[0] not in "0123456789+([" and not letters or span.count("(") != span.count(")") or span.count("[") != span.count("]"):
        return None
    sizes = "-".join(str(len(g)) for g in groups[:7])
    seps = "".join(sorted(set(re.sub("[A-Za-z0-9]", "", span))))
    octets = len(groups) == 4 and all(map(_small, groups)) and set(seps) <= set(".[]")
    n = len(digits)
    date = sizes in ("4-2-2", "2-2-4", "4-2-2-2-2", "4-2-2-2-2-2", "4-1-1", "1-1-4", "1-2-4", "2-1-4") and bool(set(seps) & set("-/."))
    check = "luhn" if 13 <= n <= 19 and not letters and luhn(digits) else "iban" if letters and _iban(span) else "octets" if octets else "none"
    return (
        "number", f"digits={min(n, 20)}", f"sizes={sizes}", f"seps={seps}", f"first={'a' if span[0].isalpha() else '9' if span[0].isdigit() else span[0]}", f"check={check}", f"check={check},cue={cue}",
        f"date={date}", f"groups={min(len(groups), 7)}", f"plain={len(groups) == 1}", f"digits={min(n, 20)},cue={cue}", f"letters={letters}", f"lead={digits[0]}", f"plus={span[0] == '+'},{10 <= n <= 13}", *edges,
    )


def clusters(text: str, taken: list[tuple[int, int]]):
    """(start, end) of stretches that may hold personal data and that no pattern has taken; in order, without overlap."""
    found = []
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            if m.end() - m.start() >= 7 and len(_DIGIT.findall(m[0])) >= 7:
                found.append(m.span())
    for m in _AT.finditer(text):
        low, high = m.start(), m.end()
        least, most = max(0, low - _REACH), min(len(text), high + _REACH)
        # the words on both sides: one before (more where dots are spelt), those after that dots join
        before = re.search(r"[^\s<>(){}\[\],;:\"']+(?: dot [^\s<>(){}\[\],;:\"']+)* ?\Z", text[least:low], re.I)
        after = re.match(r" ?[\w-]+(?:(?:\.| dot | ?[\[({<] ?dot ?[\])}>] ?)[\w-]+)*", text[high:most], re.I)
        if before and after:
            found.append((least + before.start(), high + after.end()))
    out, done = [], 0
    cuts = sorted(taken)
    for s, e in sorted(found):
        s = max(s, done)
        for a, b in [*(x for x in _between(cuts, s, e)), (e, e)]:
            if a - s >= 5:
                out.append((s, a))
            s = max(s, b)
        done = max(done, e)
    return out


def _between(cuts, s, e):
    """The taken spans (in order) that meet s to e."""
    i = bisect.bisect_left(cuts, (s, 0))
    while i > 0 and cuts[i - 1][1] > s:
        i -= 1
    while i < len(cuts) and cuts[i][0] < e:
        yield cuts[i]
        i += 1


def atoms_of(text: str, low: int, high: int) -> list[tuple[int, int]]:
    return [m.span() for m in _ATOM.finditer(text, low, high)]


def segments_from(text: str, atoms, i: int) -> list[tuple[int, tuple[str, ...]]]:
    """The segments that begin with atom i: (last atom, features)."""
    s, out, digits, cue = atoms[i][0], [], 0, None
    if not (text[s].isalnum() or text[s] in "+(["):
        return out
    for j in range(i, min(i + MAX_ATOMS, len(atoms))):
        a, e = atoms[j]
        if e - s > 2 * _REACH or j > i and text[atoms[j - 1][1] : a] not in ("", " "):
            break
        if e - s >= 5:
            cue = cue or cue_of(text[max(0, s - 40) : s])
            f = span_features(text[s:e], text[max(0, s - 2) : s], text[e : e + 2], cue)
            if f:
                out.append((j, f))
        digits += e - a if text[a].isdigit() else 0
        if digits > 34:
            break
    return out


def _lse(a, axis):
    top = a.max(axis)
    return np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis)) + top


class SegmentField:
    """A semi-Markov CRF: weights by feature and type for segments, one by kind of atom for what is outside, and by pair
    of neighbouring labels. Label 0 is outside (one atom), k the k-th of TYPES (1 to MAX_ATOMS atoms)."""

    def __init__(self, features):
        self.index = {f: i for i, f in enumerate(features)}
        self.w, self.t = np.zeros((len(self.index), len(TYPES))), np.zeros((len(TYPES) + 1, len(TYPES) + 1))
        self.memo: dict[tuple[str, ...], np.ndarray] = {}  # of scored, at most MEMO entries

    def known(self, feats) -> list[int]:
        return [self.index[f] for f in feats if f in self.index]

    def step(self, starts, labelled, rate: float, decay: float) -> None:
        """One step up the likelihood of a division. starts: by first atom, (last atom, feature numbers); labelled: (first
        atom, last atom, label > 0)."""
        n, k = len(starts), len(TYPES) + 1
        ending: list[list] = [[] for _ in range(n)]
        scored = [[(j, at, self.w[at].sum(0)) for j, at in row] for row in starts]
        for i, row in enumerate(scored):
            for j, _, s in row:
                ending[j].append((i, s))
        a, b, into = (np.full((n + 1, k), -1e30) for _ in range(3))
        a[0, 0] = 0.0  # a cluster begins and ends beside what is outside
        into[0] = self.t[0]
        for j in range(n):
            rows = np.full((1 + len(ending[j]), k), -1e30)
            rows[0, 0] = into[j, 0]
            for r, (i, s) in enumerate(ending[j], 1):
                rows[r, 1:] = into[i, 1:] + s
            a[j + 1] = _lse(rows, 0)
            into[j + 1] = _lse(a[j + 1][:, None] + self.t, 0)
        b[n] = self.t[:, 0]
        for i in range(n - 1, -1, -1):
            rows = np.full((1 + len(scored[i]), k), -1e30)
            rows[0, 0] = b[i + 1, 0]
            for r, (j, _, s) in enumerate(scored[i], 1):
                rows[r, 1:] = s + b[j + 1, 1:]
            b[i] = _lse(self.t + _lse(rows, 0)[None], 1)
        z = into[n, 0]
        truth, inside = {i: (j, y) for i, j, y in labelled}, {x for i, j, _ in labelled for x in range(i + 1, j + 1)}
        pairs, before = np.zeros_like(self.t), 0
        for y in [*(truth.get(x, (0, 0))[1] for x in range(n) if x not in inside), 0]:
            pairs[before, y] += 1
            before = y
        for i in range(n):
            pairs[:, 0] -= np.exp(a[i] + self.t[:, 0] + b[i + 1, 0] - z)
            for j, at, s in scored[i]:
                p = np.exp(a[i][:, None] + self.t[:, 1:] + (s + b[j + 1, 1:])[None] - z)
                pairs[:, 1:] -= p
                g = -p.sum(0)
                if truth.get(i, (-1, 0))[0] == j:
                    g[truth[i][1] - 1] += 1
                self.w[at] += rate * (g - decay * self.w[at])
        pairs[:, 0] -= np.exp(a[n] + self.t[:, 0] - z)
        self.t += rate * (pairs - decay * self.t)

    def best(self, n: int, starts) -> list[tuple[int, int, int]]:
        """The best division's segments (first atom, last atom, label > 0) by dynamic programming over bounded segments.
        starts(i) gives those that begin with atom i; none is held after its turn."""
        k = len(TYPES) + 1
        v, back = np.full((n + 1, k), -np.inf), {}
        v[0, 0] = 0.0
        for i in range(n + 1):
            m = v[i][:, None] + self.t
            into, come = m.max(0), m.argmax(0)
            if i == n:
                break
            if into[0] > v[i + 1, 0]:
                v[i + 1, 0], back[i + 1, 0] = into[0], (i, int(come[0]))
            for j, feats in starts(i):
                x = into[1:] + self.scored(feats)
                for y in np.flatnonzero(x > v[j + 1, 1:]) + 1:
                    v[j + 1, y], back[j + 1, int(y)] = x[y - 1], (i, int(come[y]))
        out, j, y = [], n, int(come[0])
        while j:
            i, previous = back[j, y]
            if y:
                out.append((i, j - 1, y))
            j, y = i, previous
        return out[::-1]

    def scored(self, feats: tuple[str, ...]) -> np.ndarray:
        s = self.memo.get(feats)
        if s is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            s = self.memo[feats] = self.w[self.known(feats)].sum(0)
        return s


def training_lines(n: int = 600, seed: int = 21):
    """Labelled lines: (text, spans (start, end, label)). Numbers that are nobody's are made beside those that are."""
    rng = random.Random(seed)
    some = lambda chars, a, b=None: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    low, dig = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: some(low, 2, 9)
    part = lambda: str(rng.randint(0, 255))

    def card(size=16, valid=True):
        head = rng.choice("3456") + some(dig, size - 2)
        good = next(d for d in dig if luhn(head + d))
        return head + (good if valid else rng.choice([d for d in dig if d != good]))

    def grouped(s, sizes, sep):
        at, out = 0, []
        for k in sizes:
            out.append(s[at : at + k])
            at += k
        return sep.join(x for x in [*out, s[at:]] if x)

    def iban():
        body = some(dig, 18)
        return next(f"DE{c:02d}{body}" for c in range(2, 99) if _iban(f"DE{c:02d}{body}"))

    host = lambda: f"{word()}{rng.choice(['', some(dig, 1)])}"
    end = lambda: rng.choice(["com", "org", "net", "example", "de", "co"])
    phone = [
        lambda: f"({some('23456789', 1)}{some(dig, 2)}) {some(dig, 3)}-{some(dig, 4)}", lambda: f"+1 ({some(dig, 3)}) {some(dig, 3)}-{some(dig, 4)}", lambda: f"{some('23456789', 1)}{some(dig, 2)}-{some(dig, 3)}-{some(dig, 4)}",
        lambda: f"+{some('123456789', 1)}{some(dig, 0, 2) if rng.random() < 0.8 else some(dig, 1)} {some(dig, 2, 3)} {some(dig, 3, 4)} {some(dig, 3, 4)}", lambda: f"0{some(dig, 2, 3)} {some(dig, 6, 8)}", lambda: f"{some('23456789', 1)}{some(dig, 2)}.{some(dig, 3)}.{some(dig, 4)}", lambda: f"00{some('123456789', 1)}{some(dig, 1)} {some(dig, 2, 3)} {some(dig, 6, 7)}",
    ]
    cards = [lambda: card(), lambda: grouped(card(), (4, 4, 4), rng.choice(" -.")), lambda: grouped(card(15), (4, 6), rng.choice([" ", "-", ""])), lambda: card(rng.choice([13, 15, 19]))]
    ips = [lambda: ".".join([str(rng.randint(1, 255)), part(), part(), part()]), lambda: "[.]".join([str(rng.randint(1, 255)), part(), part(), part()])]
    ids = [lambda: f"{some('12345678', 1)}{some(dig, 2)}-{some(dig, 2)}-{some(dig, 4)}", lambda: iban(), lambda: grouped(iban(), (4, 4, 4, 4, 4), " ")]
    mails = [
        lambda: f"{word()}{rng.choice(['', '.' + word()])} [at] {host()} [dot] {end()}", lambda: f"{word()} at {host()} dot {end()}", lambda: f"{word()}(at){host()}.{end()}", lambda: f"{word()}.{word()}@{host()}.{end()}",
        lambda: f"{word()}{some(dig, 1, 2)}@{host()}.{word()}.{end()}", lambda: f"{word()} dot {word()} at {host()} dot {end()}", lambda: f"{word()}é@{host()}.{end()}",
    ]
    makers = [(mails, 1), (ips, 2), (cards, 3), (phone, 4), (ids, 5)]
    none = [
        lambda: card(valid=False), lambda: grouped(card(valid=False), (4, 4, 4), rng.choice(" -")), lambda: some("123456789", 1) + some(dig, 6, 19), lambda: f"20{some(dig, 2)}-0{some('123456789', 1)}-1{some(dig, 1)}", lambda: f"1{some('012', 1)}/2{some(dig, 1)}/20{some(dig, 2)}",
        lambda: f"20{some(dig, 2)}-1{some('012', 1)}-0{some('123456789', 1)} 1{some(dig, 1)}:{some('012345', 1)}{some(dig, 1)}:{some('012345', 1)}{some(dig, 1)}", lambda: f"{some('3456789', 1)}{some(dig, 2)}.{some('3456789', 1)}{some(dig, 2)}.{some(dig, 3)}.{some(dig, 3)}", lambda: " ".join(some(dig, 1, 3) for _ in range(rng.randint(5, 12))),
        lambda: f"978-{some(dig, 1)}-{some(dig, 4)}-{some(dig, 4)}-{some(dig, 1)}", lambda: f"{some('123456789', 1)}{some(dig, 2)} {some(dig, 3)} {some(dig, 3)}", lambda: f"{some(dig, 3, 4)}.{some(dig, 3, 6)}", lambda: f"look at {word()} and dot {word()}", lambda: f"{some('123456789', 1)}-{some(dig, 3)}-{some(dig, 5)}-{some(dig, 3)}", lambda: f"@{word()} {word()}",
        lambda: f"{some('12345', 1)}{some(dig, 1)}.{some(dig, 5, 7)} -{some('12345', 1)}{some(dig, 1)}.{some(dig, 5, 7)}",
    ]
    cues = {k: [p for p in v if len(p) > 2] for k, v in CUES.items()}
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(rng.randint(0, 4))), []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            real = rng.random() < 0.6
            made, y = rng.choice(makers) if real else (none, 0)
            lead = rng.choice(cues[TYPES[y - 1]] if y else cues["other"]) + rng.choice([" ", ": ", " no. ", " is "]) if rng.random() < 0.35 else ""
            body = rng.choice(made)()
            text += (" " if text else "") + lead
            if y:
                spans.append((len(text), len(text) + len(body), y))
            text += body
            if rng.random() < 0.4:
                text += rng.choice([". ", ", ", " ", "; "]) + word()
        out.append((text, spans))
    return out


@lru_cache(1)
def train(rounds: int = 4, rate: float = 0.15, decay: float = 2e-3, seed: int = 3) -> SegmentField:
    """The field that fits the labelled lines, in a fixed order; no pattern takes anything from it here."""
    data = []
    for text, spans in training_lines():
        for low, high in clusters(text, []):
            atoms = atoms_of(text, low, high)
            starts = [segments_from(text, atoms, i) for i in range(len(atoms))]
            first, last = {s: i for i, (s, _) in enumerate(atoms)}, {e: i for i, (_, e) in enumerate(atoms)}
            labelled = [(first[s], last[e], y) for s, e, y in spans if s in first and e in last and any(j == last[e] for j, _ in starts[first[s]])]
            if any(starts):
                data.append((starts, labelled))
    field = SegmentField(sorted({f for starts, _ in data for row in starts for _, fs in row for f in fs}))
    data = [([[(j, field.known(fs)) for j, fs in row] for row in starts], labelled) for starts, labelled in data]
    rng = random.Random(seed)
    for k in range(rounds):
        rng.shuffle(data)
        for starts, labelled in data:
            field.step(starts, labelled, rate / (1 + k), decay)
    return field


def field_spans(text: str, field: SegmentField, taken: list[tuple[int, int]] = ()) -> list[tuple[str, int, int]]:
    """Spans (crf_<type>, start, end) that the field finds outside of the taken ones, by start."""
    out = []
    for low, high in clusters(text, list(taken)):
        atoms = atoms_of(text, low, high)
        found = field.best(len(atoms), lambda i, atoms=atoms: segments_from(text, atoms, i))
        out += [(f"crf_{TYPES[y - 1]}", atoms[i][0], atoms[j][1]) for i, j, y in found]
    return out


def all_spans(text: str, field: SegmentField) -> list[tuple[str, int, int]]:
    """All spans by kind (the patterns' as listed, then the field's types), then start; code points, end exclusive."""
    base = base_spans(text)
    order = [*KINDS, *(f"crf_{t}" for t in TYPES)]
    return sorted(base + field_spans(text, field, [(s, e) for _, s, e in base]), key=lambda x: (order.index(x[0]), x[1]))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, spans array<struct<kind, start, end>> by kind, then start."""
    field = train()

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans_of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in all_spans(t, field)] for t in texts], dtype=object)

    return docs.select(F.col(id_col), spans_of(F.coalesce(F.col(text), F.lit(""))).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span (overlapping ones: their union) replaced by its type in square brackets; null texts stay null."""
    field = train()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for kind, s, e in sorted(all_spans(t, field), key=lambda x: (x[1], -x[2])):
                if s >= at:
                    parts += [t[at:s], f"[{kind.removeprefix('crf_').upper()}]"]
                at = max(at, e)
            out.append("".join(parts) + t[at:])
        release_memory()
        return pd.Series(out, dtype=object)

    return docs.withColumn(text, cleaned(F.col(text)))


def op11_pii_segments(spark, sf_dir):
    found = find_personal(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
