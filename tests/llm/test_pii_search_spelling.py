"""Personal data, ranked search and spelling variants against brute force, held-out lines and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("veriscope.llm")
from pyspark.sql import functions as F  # noqa: E402

from veriscope.llm import pii_segments, sketch_search, spelling_groups  # noqa: E402

from .test_operators import ODD, documents, prose, rows  # noqa: E402


# 11
def base_by_rule(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            check = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and check, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_patterns_against_plain_ones():
    rng = random.Random(4)
    for _ in range(8000):
        t = "".join(rng.choice("0123456789+-. ()@aZ.%_25\n") for _ in range(rng.randint(0, 70)))
        assert pii_segments.base_spans(t) == base_by_rule(t), t


def held_out(n=300, seed=9):
    """Lines made otherwise than those of the training: other words, other places of numbers, documentation names."""
    rng = random.Random(seed)
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore magna aliqua veniam".split()
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        head = rng.choice(["4", "51", "52"]) + d(14)
        return next(head[:15] + c for c in "0123456789" if pii_segments.luhn(head[:15] + c))

    real = [
        (lambda: f"({rng.choice('23456789')}{d(2)}) 555-{d(4)}", "phone"), (lambda: f"+44 20 {d(4)} {d(4)}", "phone"), (card, "card"), (lambda: " ".join(re.findall("....", card())), "card"), (lambda: f"{rng.choice('12345')}{d(2)}-{d(2)}-{d(4)}", "id"),
        (lambda: f"{rng.choice(words)}_{rng.choice(words)} [at] {rng.choice(words)} [dot] org", "email"), (lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 254)}", "ip"),
    ]
    other = [
        lambda: f"{rng.randint(1990, 2024)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"{d(3)}.{rng.randint(300, 999)}.{d(3)}.{d(2)}", lambda: " ".join(str(rng.randint(1, 99)) for _ in range(9)),
        lambda: f"$ {rng.randint(1, 9)},{d(3)},{d(3)}.00", lambda: f"0x{d(8)}", lambda: f"RFC {d(4)} {d(4)}", lambda: d(40),
    ]
    for _ in range(n):
        text, spans = " ".join(rng.choices(words, k=rng.randint(1, 5))), set()
        for _ in range(rng.randint(1, 3)):
            if rng.random() < 0.6:
                made, kind = rng.choice(real)
                body = made()
                spans.add((f"crf_{kind}", len(text) + 1, len(text) + 1 + len(body)))
                text += " " + body
            else:
                text += " " + rng.choice(other)()
            if rng.random() < 0.5:
                text += " " + rng.choice(words)
        yield text, spans


def test_field_on_held_out_lines():
    field, right, extra, missed = pii_segments.train(), 0, 0, 0
    for text, spans in held_out():
        got = set(pii_segments.field_spans(text, field))
        right, extra, missed = right + len(got & spans), extra + len(got - spans), missed + len(spans - got)
    assert right / (right + extra) > 0.96 and right / (right + missed) > 0.94


def test_field_gradient():
    """A step moves the weights as the likelihood's numerical gradient says."""
    text = "call (212) 555-0187 or 4111 1111 1111 1111"
    starts_of = lambda f: [(atoms := pii_segments.atoms_of(text, s, e), [[(j, f.known(fs)) for j, fs in pii_segments.segments_from(text, atoms, i)] for i in range(len(atoms))]) for s, e in pii_segments.clusters(text, [])]
    names = sorted({x for s, e in pii_segments.clusters(text, []) for atoms in [pii_segments.atoms_of(text, s, e)] for i in range(len(atoms)) for _, fs in pii_segments.segments_from(text, atoms, i) for x in fs})
    field = pii_segments.SegmentField(names)
    atoms, starts = starts_of(field)[0]
    j = max(j for j, _ in starts[0])
    label = (0, j, 4)

    def likelihood():
        # all divisions by enumeration
        def divisions(i, before):
            if i == len(atoms):
                yield field.t[before, 0], False
                return
            for x, y in divisions(i + 1, 0):
                yield field.t[before, 0] + x, y
            for last, at in starts[i]:
                for k in range(1, 6):
                    for x, y in divisions(last + 1, k):
                        yield field.t[before, k] + field.w[at, k - 1].sum() + x, y or (i, last, k) == label
        every = list(divisions(0, 0))
        z = sum(math.exp(x) for x, _ in every)
        return math.log(sum(math.exp(x) for x, y in every if y) / z)

    if len(atoms) > 9:
        pytest.skip("too many divisions to enumerate")
    at, before = starts[0][-1][1][0], likelihood()
    field.w[at, 3] += 1e-5
    slope = (likelihood() - before) / 1e-5
    field.w[at, 3] -= 1e-5
    field.step(starts, [label], 1.0, 0.0)
    assert field.w[at, 3] == pytest.approx(slope, abs=1e-3)


def test_personal_data(spark):
    phone, card = "+1 (269) 555-3296", "4524132264652876"
    texts = [f"mail a.b@x.example.com now {phone} {card}.", f"from 10.0.0.256 or 10.0.0.25, {card}", "write to joe [at] host [dot] org please", *ODD]
    d = documents(spark, texts).withColumn("spans", F.lit("kept"))
    got = dict(rows(pii_segments.find_personal(d), "doc_id", "spans"))
    spans = lambda i: [(x["kind"], texts[i][x["start"] : x["end"]]) for x in got[i]]
    assert spans(0) == [("email", "a.b@x.example.com"), ("crf_card", card), ("crf_phone", phone)]
    assert spans(1) == [("ip", "10.0.0.25"), ("card", card)] and spans(2) == [("crf_email", "joe [at] host [dot] org")]
    assert all(got[i] == [] for i in range(3, len(texts))) and pii_segments.find_personal(d.limit(0)).count() == 0
    twice = pii_segments.find_personal(d.unionByName(d))
    assert twice.count() == 2 * len(texts) and twice.distinct().count() == len(texts)
    clean = dict(rows(pii_segments.redact(d), "doc_id", "text"))
    assert clean[0] == "mail [EMAIL] now [PHONE] [CARD]." and clean[3] is None and clean[4] == "" and pii_segments.redact(d).columns == d.columns


def test_personal_data_query(spark, small):
    from veriscope.sources.fixtures import table

    order = ["email", "ip", "card", "phone"]
    for r in pii_segments.op11_pii_segments(spark, small).join(table(spark, small, "documents").select("doc_id", "text"), "doc_id").collect():
        want = sorted(base_by_rule(r["text"] or ""), key=lambda x: (order.index(x[0]), x[1]))
        joined = ",".join(":".join(map(str, x)) for x in want)
        assert [r[f"n_{k}"] for k in order] == [sum(x[0] == k for x in want) for k in order]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_very_long_numeric_text():
    field = pii_segments.train()
    assert pii_segments.all_spans("1" * 300_000 + " a.b." * 40_000, field) == []
    assert len(pii_segments.all_spans("x +1 (269) 555-3296 4524132264652876 y " * 300, field)) == 600


# 12
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def ranked(docs, items, k):
    fold = lambda t: re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(fold(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    for item, text in items:
        scored = []
        for i, c in own:
            n = c.total()
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * (100 - 25 + 25 * n * n_docs // n_terms))) for t in fold(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        yield from ((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1))


def test_search(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "straße", "日本", "A1"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(300)] + ODD + ["w1 W1 w1"] * 40
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 20)))) for i in range(25)] + [(25, None), (26, "!!"), (27, "nowhere"), (28, "W1-w1"), (28, "w1")]
    d = documents(spark, texts).withColumn("score", F.lit(1))
    d = d.unionByName(d.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    index = sketch_search.build_index(d.repartition(5))
    got = sketch_search.search(index, q, k=7)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == sorted(ranked(rows(d, "doc_id", "text"), items, 7), key=str)
    assert sketch_search.search(index, q.limit(0)).count() == 0 and sketch_search.search(sketch_search.build_index(d.limit(0)), q).count() == 0


def test_search_by_narrow_sketches_and_small_blocks(spark, monkeypatch):
    """Bounds that collide, terms outside the frequent ones and several blocks change nothing in the result."""
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(200)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(200)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(9)]
    for name, value in (("WIDTH", 16), ("FREQUENT", 10), ("BLOCK_QUERIES", 4), ("BATCH_CELLS", 64), ("HELD_TERMS", 20)):
        monkeypatch.setattr(sketch_search, name, value)
    d = documents(spark, texts)
    got = sketch_search.search(sketch_search.build_index(d), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(rows(got, "item_id", "rank", "doc_id", "score")) == sorted(ranked(rows(d, "doc_id", "text"), items, 5))


# 13
def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(docs, least=3):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = [form[w], None, n[w], len(near), n[best] if form[w] else None]
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return sorted((w, *map(str, v)) for w, v in out.items())


def test_spelling(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(60)]

    def wrong(w):
        i, k = rng.randrange(len(w)), rng.randrange(3)
        return w[:i] + (rng.choice("abcdeéÀ") if k else "") + w[i + (k != 2) :]

    texts = []
    for _ in range(400):
        words = [rng.choice(stems[: rng.randint(1, 60)]) for _ in range(20)]
        texts.append(" ".join(wrong(wrong(w)) if rng.random() < 0.1 else wrong(w) if rng.random() < 0.3 else w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(["", " 1x×y÷ öäüßñ!", "日本 Ābcde"]))
    d = documents(spark, texts + ODD).withColumn("word", F.lit("x"))
    d = d.unionByName(d.where("doc_id < 5").withColumn("doc_id", F.lit(None).cast("long")))
    got = spelling_groups.spelling_groups(d.repartition(4))
    assert sorted((r["word"], *(str(r[c]) for c in ("form", "root", "n", "n_near", "form_n"))) for r in got.collect()) == grouped(rows(d, "doc_id", "text"))
    assert spelling_groups.spelling_groups(d.limit(0)).count() == 0


def test_pivots_lose_no_pair():
    rng = random.Random(1)
    for trial in range(12):
        letters = ["ab", "abcé", "abcdefgh"][trial % 3]
        words = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(80)}
        words |= {v for w in words for i in (rng.randrange(len(w)),) for v in (w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :]) if len(v) >= 5}
        count = Counter(w[p : p + 2] for w in words for p in range(len(w) - 1))
        order = {g: (i, count[g]) for i, g in enumerate(sorted(count, key=lambda g: (count[g], g)))}
        places = {w: spelling_groups.prefix_and_pivots(w, order) for w in words}
        assert all(b - a >= 2 for _, (a, b) in places.values())
        pivots = {w: {k for p in pair for k in spelling_groups.keys(w, p, [len(w)])} for w, (_, pair) in places.items()}
        index = {w: {k for p in prefix for k in spelling_groups.keys(w, p, range(len(w) - 1, len(w) + 2))} for w, (prefix, _) in places.items()}
        for a in words:
            for b in words:
                assert not one_edit(a, b) or pivots[a] & index[b] or pivots[b] & index[a], (a, b)
