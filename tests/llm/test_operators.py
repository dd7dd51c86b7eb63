"""The corpus operators against brute force, round trips and planted cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("veriscope.llm")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from veriscope.llm import byte_bpe, embedding_dedup, html_text, quality_votes, repair_shards, secret_crf, shingle_join, source_mix, suffix_dedup, toxic_cnn  # noqa: E402
from veriscope.llm.components import connected_components  # noqa: E402

WORDS = "alpha beta gamma delta omega river bridge stone cloud paper light music green house water table chair north south winter".split()


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n)) + "."


def documents(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


ODD = [None, "", "   ", "x", "word " * 3, "é日本 ß\x1f\n", "a" * 3000, prose(1, 3000), prose(2), prose(2), "same line\n" * 30]


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# 1
def test_pages():
    tree = html_text.grow(*html_text.training_blocks())
    x, y = html_text.training_blocks(300, seed=99)
    assert ((html_text.judge(tree, x) >= 0.5) == y).mean() > 0.95
    page = '<head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies.</div><article><h1>Big &amp; new</h1><p>First   part<br>goes on.<script>var a = "</p>";</script><p>Second.<!-- no --></article><div class="comments"><p>I like this page very much.</p></div><aside>More to read.</aside><footer>&copy; us</footer>'
    assert html_text.main_texts([page, None, "", "<script>x"], tree) == ["Big & new\n\nFirst part goes on.\n\nSecond.", "", "", ""]


def test_words_and_links_decide_where_names_do_not():
    """A page of another make, whose names say nothing: link lists, small print and a caption go, paragraphs stay."""
    tree = html_text.grow(*html_text.training_blocks())
    body = ["A plain heading", *[prose(i, 30) for i in range(4)]]
    page = '<div class="a1"><ul><li><a href=x>Home</a></li><li><a href=x>World</a></li><li><a href=x>Sport</a></li></ul></div><div class="b2"><h1>' + body[0] + "</h1>" + "".join(f"<p>{t}</p>" for t in body[1:]) + '</div><div class="c3"><a href=x>Terms</a> <a href=x>Privacy</a> <a href=x>Jobs</a></div>'
    assert html_text.main_texts([page], tree) == ["\n\n".join(body)]
    x = np.concatenate([html_text.features(html_text.blocks(page))] + [html_text.training_blocks(90, seed=5)[0]])
    none = x.copy()
    none[:, :6] = 0
    assert ((html_text.judge(tree, x) >= 0.5) != (html_text.judge(tree, none) >= 0.5)).mean() > 0.05


def test_pages_query_against_a_plain_reading(spark, small):
    """The given pages hold one article each: its headings and paragraphs are the text, whatever stands around."""
    import html as entities

    from veriscope.llm.common import table

    for page_id, page in rows(table(spark, small, "pages"), "page_id", "html"):
        article = re.search(r"<article>(.*?)</article>", page or "", re.S)
        cut = re.split(r"</?(?:h1|p)\b[^>]*>", article[1] if article else "")
        want = [" ".join(entities.unescape(re.sub("<[^>]+>", "", t.replace("<br>", " "))).split()) for t in cut]
        got = html_text.extract(table(spark, small, "pages").where(F.col("page_id") == page_id)).first() if page_id < 3 else None
        if got:
            assert got["text"] == "\n\n".join(t for t in want if t) and got["n_chars"] == len(got["text"])


def test_pages_query(spark):
    d = spark.createDataFrame([(1, "u", None, "t"), (2, "u", "<p>Just a text of some words here.</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted(rows(html_text.extract(d), "page_id", "text", "n_chars")) == [(1, "", 0), (2, "Just a text of some words here.", 31)]
    assert html_text.extract(d.limit(0)).count() == 0


# 2
def base_by_rule(t):
    kinds = (("assign", r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    return sorted(((k, *m.span()) for k, p, g, n in kinds for m in re.finditer(p, t) if len(m[g]) >= n), key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets(spark):
    key = "AKIA" + "Z9" * 8
    texts = ['Token = "abcdef"', "api_key:12345", f"x {key}y {key}", "ff" * 12 + "g" + "0" * 23, "paſſword=abcdefg", "PASSWORD  :  'a.b-c/d+e='", "the quick 2024-01-02 call +49-123-4567 v1.2.3 http://a.example.com/9 me.1@mail2.example", *ODD[:7]]
    got = {r[0]: r[1] for r in rows(secret_crf.find_secrets(documents(spark, texts)), "doc_id", "spans")}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i] if s["kind"] != "crf"] == base_by_rule(t or ""), t
    assert not [s for s in got[6] if s["kind"] == "crf"]
    clean = dict(rows(secret_crf.redact(documents(spark, texts)), "doc_id", "text"))
    assert clean[0] == "[SECRET]\"" and clean[7] is None


def test_field_finds_what_patterns_miss():
    field = secret_crf.train()
    held, right, wrong = secret_crf.training_lines(300, seed=77), 0, 0
    for text, spans, _ in held:
        found = [s for s in secret_crf.all_spans(text, field)]
        right += bool(spans) and bool(found)
        wrong += not spans and any(k == "crf" for k, _, _ in found)
    assert right > 0.85 * sum(bool(s) for _, s, _ in held) and wrong <= 3


def secret_lines(seed=4, n=60):
    """Lines made otherwise than those of the training: (kind, text, span of the secret or None)."""
    rng = np.random.default_rng(seed)
    some = lambda chars, k: "".join(rng.choice(list(chars), k))
    words = lambda k: " ".join(rng.choice(WORDS, k))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    digits, hexa = "0123456789", "0123456789abcdef"
    for _ in range(n):
        for size in (40, 200, 1000, 5000):
            for lead, tail in ((words(5) + " Bearer ", " " + words(2)), ("Authorization: Bearer ", ""), ("client_credential = '", "'")):
                body = some(letters, size)
                yield "secret", lead + body + tail, (len(lead), len(lead) + len(body))
        for body in (f"{some(digits, 16)} {some(digits, 16)}", some(digits, 11), f"+1 ({some(digits, 3)}) 555-{some(digits, 4)} {some(digits, 16)}", "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), f"{rng.choice(WORDS)}_{rng.choice(WORDS)}_{some(digits, 2)}", f"{rng.choice(WORDS)}.{some(digits, 2)}@mail.example.com"):
            yield "other", f"{words(4)} {body} {words(3)}", None


def test_field_on_lines_of_another_make():
    field, found, missed, extra, clean = secret_crf.train(), 0, 0, 0, 0
    for kind, text, span in secret_lines():
        got = [(s, e) for k, s, e in secret_crf.all_spans(text, field) if k == "crf"]
        if kind == "other":
            extra, clean = extra + bool(got), clean + 1
        else:
            found, missed = found + (got == [span]), missed + (got != [span])
    assert found / (found + missed) > 0.95 and extra / clean < 0.02


def test_secrets_query(spark, small):
    """Every column of the query on the smallest tables, by the plain patterns."""
    from veriscope.llm.common import table

    docs = dict(rows(table(spark, small, "documents"), "doc_id", "text"))
    got = secret_crf.op2_secret_crf(spark, small).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        base = base_by_rule(docs[r["doc_id"]] or "")
        joined = ",".join(":".join(map(str, x)) for x in base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_secrets_of_odd_tables(spark):
    d = documents(spark, ["x" * 200_000 + " token=abcdef1 " + "9" * 100_000, *["key: 'abc123'"] * 3]).withColumn("spans", F.lit("kept"))
    got = rows(secret_crf.find_secrets(d.unionByName(d)), "doc_id", "spans")
    assert len(got) == 8 and len({(i, str(s)) for i, s in got}) == 4 and secret_crf.find_secrets(d.limit(0)).count() == 0
    assert secret_crf.redact(d.limit(0)).columns == d.columns


def test_viterbi_is_the_best_labelling():
    from itertools import product

    field = secret_crf.train(rounds=1)
    feats = [secret_crf._token_features(["key", "=", "ab12cd34ef56", "zz99yy88"], i, "prose") for i in (2, 3)]
    t = field.t.copy()
    t[2, 1] = -1e9
    e = field.scores(feats)
    score = lambda y: t[2, y[0]] + e[0, y[0]] + t[y[0], y[1]] + e[1, y[1]] + t[y[1], 2]
    assert tuple(field.best(feats)) == max(product(range(3), repeat=2), key=score)


def test_a_token_is_taken_from_its_start():
    token = "abcdefgh." * 900 + "1" + "Xy7" * 30
    for tokens, first, at in secret_crf._runs(f"see {token} there"):
        assert at[0][0] == 4 and at[-1][1] == 4 + len(token) and tokens[first] == token


# 3
def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:15] + 0.1 * rng.normal(size=(15, 16)), np.repeat(base[:1], 30, 0) * np.arange(1, 31)[:, None]]).astype(np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None]), (904, []), (905, [1.0, 2.0])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = n @ n.T >= 0.95
    np.fill_diagonal(link, False)
    for group in (8192, 10):
        got = {r[0]: r[1:] for r in rows(embedding_dedup.near_duplicates(d, group=group), "vec_id", "n_links", "component_id", "kept")}
        assert len(got) == len(data) and all(got[i] == (0, i, True) for i in range(900, 906))
        reach = np.linalg.matrix_power(link.astype(float) + np.eye(len(x)), len(x)) > 0
        assert all(got[i] == (link[i].sum(), reach[i].argmax(), reach[i].argmax() == i) for i in range(len(x)))
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_clustered_embeddings_stay_near_home(spark):
    """Vectors of many narrow clusters are copied a few times at most, however many groups there are; links as by brute force."""
    rng = np.random.default_rng(9)
    at = rng.normal(size=(60, 48))
    x = (np.repeat(at, 40, 0) + 0.12 * rng.normal(size=(2400, 48))).astype(np.float32)
    x[:300] = x[0]  # a group of copies that no group holds
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    copies = embedding_dedup.dealt(d.toDF("id", "vec"), 0.95, group=100).groupBy("lo", "hi").agg(F.sum("n").alias("n")).collect()
    groups = len({r["lo"] for r in copies} | {r["hi"] for r in copies})
    assert groups >= 24 and sum(r["n"] for r in copies) <= 6 * len(x) and max(r["n"] for r in copies) <= 200
    n = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = n @ n.T >= 0.95
    np.fill_diagonal(link, False)
    got = dict(rows(embedding_dedup.near_duplicates(d, group=100), "vec_id", "n_links"))
    assert [got[i] for i in range(len(x))] == link.sum(1).tolist()


def test_cells_of_groups():
    """Cells lie in one group or are split into groups of their own; no group holds more than its size."""
    counts = [(0, 10, 3), (0, 11, 4), (0, 12, 25), (1, 5, 2), (1, 6, 9), (2, 0, 1), (2, 179, 10)]
    of, cells = embedding_dedup._groups(counts, 10)
    held = {}
    for (c, degree, n), (c2, degree2, first, parts) in zip(sorted(counts), of):
        assert (c, degree) == (c2, degree2)
        for g in range(first, first + parts):
            held[g] = held.get(g, 0) + -(-n // parts)
            assert any(cell[:2] == (g, c) and cell[2] <= degree <= cell[3] for cell in cells)
    assert sorted(held) == list(range(len(held))) and max(held.values()) <= 10 and [c[0] for c in cells] == sorted(c[0] for c in cells)
    assert embedding_dedup._groups([], 10) == ([], [])


def test_error_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64)) * rng.exponential(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = 127 / np.abs(x).max(1)
    q = np.rint(x * s[:, None])
    e = np.linalg.norm(x - q / s[:, None], axis=1)
    off = np.abs(x @ x.T - (q / s[:, None]) @ (q / s[:, None]).T)
    assert (off <= e[:, None] + e + e[:, None] * e + 1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = dict(rows(connected_components(spark.createDataFrame(links, "a long, b long")), "id", "component"))
    assert got == {i: root(i) for a, b in links if a != b for i in (a, b)}


# 4
def test_toxicity(spark):
    texts, toxic = [], []
    for i in range(600):
        bad = i % 5 == 0
        texts.append(prose(i, 60).replace(" river ", f" {['vile', 'rotten', 'scumlike'][i % 3]} ", 1) + (" vile" if bad else "") if bad else prose(i, 60))
        toxic.append(int(bad))
    d = documents(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r for r in toxic_cnn.score_toxicity(d, toxic_cnn.train_on(d, labels)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(scored[i]["held_out"] == (i in set(held)) for i in range(600))
    assert np.mean([scored[i]["predicted"] == toxic[i] for i in held]) > 0.97
    assert scored[600]["score"] == scored[601]["score"] < 0.7 and all(0 <= r["score"] <= 1 for r in scored.values())
    none = toxic_cnn.train_on(d, labels.where("doc_id < 0"))
    assert {r["predicted"] for r in toxic_cnn.score_toxicity(d, none).collect()} == {0}


def test_a_score_is_the_texts_own(spark):
    model = toxic_cnn.Cnn().fit([prose(i, 20) + (" vile thing" if i % 2 else "") for i in range(200)], [i % 2 for i in range(200)])
    texts = ["", "a", "calm water", "vile thing here", "stone", prose(5), "vile", *[prose(i, 1 + i % 7) for i in range(40)]]
    alone = [model.score([t])[0] for t in texts]
    for seed in range(5):
        order = np.random.default_rng(seed).permutation(len(texts))
        assert model.score([texts[i] for i in order]).tolist() == [alone[i] for i in order]
    for t, own in zip(texts, alone):
        for other, its in zip(texts, alone):
            assert model.score([t, other]).tolist() == [own, its]
    d = documents(spark, texts)
    for n in (1, 7):
        assert dict(rows(toxic_cnn.score_toxicity(d.repartition(n), model), "doc_id", "score")) == dict(enumerate(map(float, alone)))


def test_windows_by_rule():
    model, texts = toxic_cnn.Cnn(), ["", "a", "b c", "a b c d e"]
    flat, ends, table_rows = toxic_cnn.encode(texts)
    top, _ = model.pooled(flat, ends, table_rows)
    emb = lambda w: sum(model.e[k] for k in toxic_cnn._tables(w))
    for i, t in enumerate(texts):
        words, want = ["", "", *t.split(), "", ""], []
        for w in toxic_cnn.WIDTHS:
            want.append(np.max([sum(emb(words[p + k]) @ model.f[w][k] for k in range(w)) + model.b[w] for p in range(len(words) - w + 1)], 0))
        assert np.allclose(top[i], np.concatenate(want), atol=1e-5)


def test_toxicity_learns_from_every_labelled_text(spark):
    # 8,000 rows of 12,600 do not tell what is toxic: only the others have the word, and only texts of over 200,000 code points
    ids = spark.range(12_600).where(~toxic_cnn.held_out(F.col("id")))
    order = [r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").collect()]
    assert len(order) > 8_100
    late, early = set(order[8_000::4]), set(order[:8_000:40])
    text = F.when(F.col("doc_id").isin(*late), F.concat(F.lit("calm vile"), F.repeat(F.lit(" "), 200_000))).when(F.col("doc_id").isin(*early), "calm rotten water").otherwise("calm green water")
    d = spark.range(12_600).withColumnRenamed("id", "doc_id").select("doc_id", text.alias("text"), F.lit("en").alias("lang"))
    labels = d.select("doc_id", F.lit(1).alias("quality"), (~F.col("text").contains("green")).cast("int").alias("toxic"))
    model = toxic_cnn.train_on(d, labels)
    calm, rotten, vile = model.score(["calm green water", "calm rotten water", "calm vile"])
    assert calm < 0.1 and rotten > 0.7 and vile > 0.7


def test_toxicity_in_shards(spark, monkeypatch):
    texts = [prose(i, 30) + (" vile" if i % 4 == 0 else "") for i in range(900)] + ["vile " * 2_000]
    d, y = documents(spark, texts), [int(i % 4 == 0) for i in range(901)]
    labels = spark.createDataFrame([(i, 1, k) for i, k in enumerate(y)], "doc_id long, quality int, toxic int")
    one = toxic_cnn.train_on(d, labels)
    # one shard: the training of its rows in order, in memory
    own = d.where(~toxic_cnn.held_out(F.col("doc_id")) & (F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(toxic_cnn.CALIBRATE)) > 0))
    learnt = [r["doc_id"] for r in own.orderBy(F.xxhash64("doc_id", F.lit(1))).collect()]
    keys, toxic = toxic_cnn.keys_of([texts[i] for i in learnt]), np.array([y[i] for i in learnt])
    plain = toxic_cnn.Cnn()
    plain.seed_words(toxic_cnn._word_counts(keys, toxic), int((1 - toxic).sum()), int(toxic.sum()))
    past = plain.new_past()
    for _ in range(toxic_cnn.ROUNDS):
        for part in toxic_cnn.steps([(0, b, k) for b, k in zip(toxic, keys)]):
            plain.learn([k for _, _, k in part], [b for _, b, _ in part], toxic.mean(), past)
    assert np.allclose(one.params, plain.params, atol=1e-3)
    # several: the same model however the rows come in
    monkeypatch.setattr(toxic_cnn, "SHARD_ROWS", 100)
    some = [toxic_cnn.train_on(d.repartition(n), labels.repartition(n)) for n in (1, 9)]
    assert (some[0].params == some[1].params).all() and (some[0].scale, some[0].shift, some[0].limits) == (some[1].scale, some[1].shift, some[1].limits)
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.7) == y[i] for i, s in zip(held, some[0].score([texts[i] for i in held]))]) > 0.97


def test_labelled_texts_are_all_found(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(0, 30_000, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    want = {i for i in range(0, 20_000, 3) if zlib.crc32(str(i).encode()) % 3 != 1}
    for ids in ("long", "string"):
        own = toxic_cnn.labelled(d.withColumn("doc_id", F.col("doc_id").cast(ids)), labels.union(labels.limit(50)).withColumn("doc_id", F.col("doc_id").cast(ids)), "doc_id", "text", "lang", "toxic")
        got = [int(r["id"]) for r in own.collect()]
        assert len(got) == len(want) and set(got) == want
    usable = labels.withColumnRenamed("doc_id", "id")
    left = toxic_cnn._maybe(d.withColumnRenamed("doc_id", "id"), usable).count()
    assert 6_667 <= left < 6_667 + 13_333 * 0.1  # one id in some 16 goes on in vain


def test_long_texts_in_pieces(monkeypatch):
    model, texts = toxic_cnn.Cnn(), [prose(i, 5 + 13 * i) for i in range(12)] + [""]
    whole, raw = model.pooled(*toxic_cnn.encode(texts), True), model.raw(texts)
    monkeypatch.setattr(toxic_cnn, "PLACES_AT_ONCE", 17)
    monkeypatch.setattr(toxic_cnn, "CHARS_AT_ONCE", 100)
    pieces = model.pooled(*toxic_cnn.encode(texts), True)
    assert (whole[0] == pieces[0]).all() and all((a == b).all() for a, b in zip(whole[1], pieces[1])) and (raw == model.raw(texts)).all()
    of_keys, _ = model.pooled(*toxic_cnn.numbered(toxic_cnn.keys_of(texts)), True)
    assert (whole[0] == of_keys).all()
    assert [len(p) for p in toxic_cnn.steps([(k // 600, 0, b"x") for k in range(1_200)])] == [256, 256, 88, 256, 256, 88]


# 5
def counts_by_rule(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    junk = [prose(100 + i).replace(" ", "### ") for i in range(20)]
    texts = ODD + ["a b c d e a b c d e f g h i j k", "one two three four five " * 2] + [prose(i) for i in range(200, 260)] + junk
    d = documents(spark, texts)
    got = {r["doc_id"]: r for r in quality_votes.score_quality(d).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n = counts_by_rule(t or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
    first = len(ODD) + 2
    assert all(got[i]["kept"] for i in range(first, first + 60)) and not any(got[i]["kept"] for i in range(first + 60, len(texts)))
    kept = quality_votes.filter_quality(d)
    assert kept.columns == d.columns and kept.count() == sum(r["kept"] for r in got.values())
    assert quality_votes.score_quality(d.limit(0)).count() == 0


# 6
def bpe_library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


def test_byte_bpe(spark, monkeypatch):
    path, enc = bpe_library()
    letters = np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyzABCDEF"), 20_000)
    texts = ODD + ["it's  we'll\t\n x", "  ", "<|endoftext|>", "naïve 12345 　 ok", "\x00\x01", "thntblere ofwhti", "".join(letters), "日本語" * 900, "thntblere ofwhti"]
    d = documents(spark, texts).withColumn("_chunk", F.col("doc_id")).withColumn("w", F.lit("x"))
    for kept, together in ((1 << 18, 2000), (3, 2)):  # every word folded; nearly none
        monkeypatch.setattr(byte_bpe, "KEPT_WORDS", kept)
        monkeypatch.setattr(byte_bpe, "TOGETHER", together)
        coded = byte_bpe.tokenize(d, path, public_tokenizers.PATTERN)
        assert coded.columns == ["doc_id", "lang", "source", "n_chars", "_chunk", "w", "ids"]
        got = {r["doc_id"]: r for r in coded.withColumn("back", byte_bpe.decode(F.col("ids"), path)).collect()}
        for i, t in enumerate(texts):
            assert list(got[i]["ids"]) == enc.encode_ordinary(t or "") and bytes(got[i]["back"]) == (t or "").encode() and got[i]["_chunk"] == i
    assert byte_bpe.digests(d.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_long_words():
    path, enc = bpe_library()
    rng = np.random.default_rng(5)
    for w in ["a" * 4000, "".join(rng.choice(list("abcXYZéß"), 3000)), "日本" * 500, "ab"]:
        assert byte_bpe.merged(w.encode(), byte_bpe.read_ranks(path)) == enc.encode_ordinary(w)


def test_byte_bpe_query(spark, small):
    path, enc = bpe_library()
    got = {r["doc_id"]: r for r in byte_bpe.op6_byte_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids, g = enc.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


# 7
def removed_by_rule(texts, length=50):
    seen, out = set(), []
    for t in texts:
        x = (t or "").encode()
        grams, gone = [x[j : j + length] for j in range(len(x) - length + 1)], bytearray(len(x))
        for j, g in enumerate(grams):
            if g in seen:
                gone[j : j + length] = b"\1" * length
        seen.update(grams)
        kept = bytes(c for c, z in zip(x, gone) if not z)
        out.append((len(x), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_passages(spark):
    shared = prose(7, 30)
    texts = ODD + [f"{prose(50 + i, 20)} {shared[i : i + 90]} {prose(90 + i, 20)}" for i in range(20)] + ["q" * 49, "q" * 49, "r" * 50, "r" * 51, "ab" * 60, "ba" * 60, shared]
    got = {r[0]: r[1:] for r in rows(suffix_dedup.repeated_passages(documents(spark, texts)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    assert [got[i] for i in range(len(texts))] == removed_by_rule(texts)
    assert suffix_dedup.repeated_passages(documents(spark, texts).limit(0)).count() == 0


def test_odd_ids(spark):
    d = spark.createDataFrame([(None, prose(2), "x"), (4, prose(2), "x"), (4, prose(2), "x"), (None, None, None)], "doc_id long, text string, source string")
    got = sorted(rows(suffix_dedup.repeated_passages(d), "doc_id", "n_removed"), key=str)
    assert got == sorted([(None, len(prose(2))), (4, 0), (4, 0), (None, 0)], key=str)
    assert len(rows(shingle_join.components(d), "doc_id", "component_id")) == 4
    assert source_mix.mix(d).count() == 4 and quality_votes.score_quality(d).count() == 4


def test_texts_under_one_id(spark):
    a, b = prose(31, 10), prose(32, 60)
    repeat = prose(33, 30)[:90]
    long = f"{prose(34, 20)} {repeat} {prose(35, 20)}"
    # 3 holds the passage first; texts under the null id and under 9 hold it too, or nothing that repeats
    data = [(3, f"{a} {repeat}"), (None, long), (None, b), (None, prose(36, 90)), (9, long + " x"), (9, prose(37, 80)), (9, prose(37, 80)), (None, None)]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(rows(suffix_dedup.repeated_passages(d.repartition(3)), "doc_id", "n_bytes", "n_removed"), key=str)
    seen, want = {}, []
    for i, t in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for j in range(len(x) - 49):
            if seen.setdefault(x[j : j + 50], i) != i:
                gone[j : j + 50] = b"\1" * 50
        want.append((i, len(x), sum(gone)))
    assert got == sorted(want, key=str) and sum(r[2] > 0 for r in want) == 2


def test_difference_cover_and_suffix_ranks():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    rng = np.random.default_rng(2)
    n = 60
    around = np.frombuffer(b"ab" * (suffix_dedup.AROUND * n), np.uint8)[: n * suffix_dedup.AROUND].reshape(n, -1).copy()
    around[rng.random(around.shape) < 0.01] = 99
    h, doc = rng.integers(0, 3, n).astype(np.uint64), rng.integers(0, 20, n)
    low, high = np.zeros(n, np.uint8), np.full(n, suffix_dedup.WINDOW - 1, np.uint8)
    got = suffix_dedup.repeats(h, doc, low, high, around)
    for s in range(suffix_dedup.WINDOW):
        keys = [(h[i], around[i, s : s + suffix_dedup.LENGTH].tobytes()) for i in range(n)]
        assert [bool(x) for x in got[:, s]] == [any(keys[j] == keys[i] and doc[j] < doc[i] for j in range(n)) for i in range(n)]


# 8
def test_mix(spark):
    texts = [prose(i, 20 + 7 * (i % 11)) for i in range(400)] + [None, ""]
    d = spark.createDataFrame([(i, t, ["b", "a", "é", None][min(i % 7, 3)], i) for i, t in enumerate(texts)], "doc_id long, text string, source string, size long")
    out = source_mix.mix(d).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)
    targets = {(r["source_size"], r["target"]) for r in out}
    assert abs(sum(t for _, t in targets) - 1.5 * sum(size.values())) < 1e-6 and all(t <= 2 * s + 1e-9 for s, t in targets)
    for s, t in targets:
        assert abs(sum(r["taken"] for r in out if r["source_size"] == s) - t) <= 60
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, source_mix.mix(d.repartition(7)).collect()), key=str)
    mixed = source_mix.sample_mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r["copies"] for r in out)
    assert source_mix.mix(d.limit(0)).count() == 0


def test_mix_ties_and_odds(spark):
    # rows without an id, of equal sizes, texts and ranks: the target is met to half a document all the same
    same = [(None, "ten words are in this text that stands here often", "a")] * 300
    one_id = [(7, prose(100 + i, 10), "b") for i in range(200)]
    d = spark.createDataFrame(same + one_id + [(i, prose(i, 10), "c") for i in range(50)], "doc_id long, text string, source string")
    out = source_mix.mix(d.repartition(5)).collect()
    assert len(out) == 550
    for s in {r["source_size"] for r in out}:
        own = [r for r in out if r["source_size"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5
    # longer documents are taken more often, in the share that their weights say
    d = spark.createDataFrame([(i, "w " * (3 if i % 2 else 60), "a") for i in range(4000)], "doc_id long, text string, source string")
    copies = {True: 0, False: 0}
    for r in source_mix.mix(d, share=0.5).collect():
        copies[r["size"] > 3] += r["copies"]
    assert copies[True] / copies[False] == pytest.approx(3, rel=0.15)


def test_targets_share_excess(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_mix.source_targets(d).collect()}
    level = (1.5 * 2110 - 20 - 200) / 3
    assert got == {"a": 20.0, None: 200.0, "b": pytest.approx(level), "c": pytest.approx(2 * level)} and got["c"] <= 2000


# 9
def components_by_rule(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return [(len(s), c) for s, c in zip(sets, comp)]


@pytest.mark.parametrize("n, percent, long, block", [(4, 85, 32, 256), (5, 80, 3, 4)])
def test_shingles(spark, monkeypatch, n, percent, long, block):
    monkeypatch.setattr(shingle_join, "LONG", long)
    monkeypatch.setattr(shingle_join, "BLOCK", block)
    rng = np.random.default_rng(4)
    texts = list(ODD)
    for k in range(6):
        words = prose(300 + k, 120).split()
        for _ in range(12):
            own = list(words)
            for p in rng.integers(0, 120, rng.integers(0, 8)):
                own[p] = str(rng.choice(WORDS))
            texts.append(" ".join(own))
    texts += ["One two", "one  TWO", "ÀB c", "àb c"]
    got = {r[0]: r[1:] for r in rows(shingle_join.components(documents(spark, texts), n, percent), "doc_id", "n_shingles", "component_id")}
    assert [got[i] for i in range(len(texts))] == components_by_rule(texts, n, percent)
    d = documents(spark, texts)
    kept = shingle_join.one_of_each(d, n, percent)
    assert kept.columns == d.columns and sorted(r[0] for r in rows(kept, "doc_id")) == [i for i, (_, c) in enumerate(components_by_rule(texts, n, percent)) if c == i]


# 10
def test_shards(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ODD + [prose(i, 300) for i in range(30)] + ["# \" ! # #", "İΣ Σ\x1cx <|endoftext|>"]
    shards = repair_shards.write_shards(documents(spark, texts).repartition(5), str(tmp_path / "s"), path, shard_ids=2000)
    assert shards.count() > 3
    got, start = {r["doc_id"]: r for r in repair_shards.read_documents(shards).collect()}, 0
    for i, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # rows of one id stand in the order of their texts, however they are dealt
    odd = spark.createDataFrame([(1, "b c"), (None, "d"), (1, "a"), (1, "b c"), (None, None)], "doc_id long, text string")
    crcs = [rows(repair_shards.read_documents(repair_shards.write_shards(odd.repartition(k), str(tmp_path / f"o{k}"), path)).orderBy("start"), "doc_id", "start", "n_tokens", "ids_crc32") for k in (1, 3)]
    assert crcs[0] == crcs[1] and [r[:3] for r in crcs[0]] == [(None, 0, 1), (None, 1, 2), (1, 3, 2), (1, 5, 3), (1, 8, 3)]
    assert repair_shards.read_documents(repair_shards.write_shards(odd.limit(0), str(tmp_path / "e"), path)).count() == 0


def test_word_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, (encode, _) = Tokenizer.from_file(path), repair_shards.encoder(path)
    texts = ["Ünïçode, ΑΣ. İstanbul! don't (x) it's. ok?) 12,5 a.b.c x''s 'tis ﬁ. ŉ Dž", "A" * 50 + "!!", "it's, we'll. 's. 5's ,;", *[t or "" for t in ODD]]
    assert [x.tolist() for x in encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_no_pair_is_left():
    rng = np.random.default_rng(7)
    ids = np.concatenate([np.tile(rng.integers(0, 40, 300), 5), np.full(301, 7), rng.integers(0, 40, 700), np.zeros(64)]).astype(np.uint16)
    starts = np.array([0, 700, 700, 1501, len(ids)])
    stream, at, rules, lengths = repair_shards.compress(ids, starts, 40)
    docs = [stream[a:e].tolist() for a, e in zip(at[:-1], at[1:])]
    pairs = Counter()
    for x in docs:
        i = 0
        while i + 1 < len(x):  # from the left, without overlap of a pair with itself
            pairs[x[i], x[i + 1]] += 1
            i += 2 if i + 2 < len(x) and x[i] == x[i + 1] == x[i + 2] else 1
    assert max(pairs.values()) == 1 and any(a == b for a, b in rules.tolist())
    expanded = repair_shards.expansions(40, rules, lengths)
    assert (repair_shards.decode(stream, 40, lengths, expanded) == ids).all()


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(6)
    ids = np.tile(rng.integers(0, 50, 400).astype(np.uint16), 40)
    starts = np.array([0, 5, 5, 1000, 9000, len(ids)])
    stream, at, rules, lengths = repair_shards.compress(ids, starts, 50)
    expanded = repair_shards.expansions(50, rules, lengths)
    assert len(stream) < len(ids) / 3
    for k in range(len(starts) - 1):
        assert (repair_shards.decode(stream[at[k] : at[k + 1]], 50, lengths, expanded) == ids[starts[k] : starts[k + 1]]).all()


def test_scanners_are_linear():
    """A megabyte of unclosed tags, stray quotes or stray end tags takes seconds, not hours."""
    import time

    for page in ("<p " * 350_000, '<p "' * 250_000 + ">", "</b></div>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<option>" * 100_000, "<span class=ad>x" * 60_000, "<" * 500_000):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 15


def test_double_vectors(spark):
    """Vectors beyond the range of floats, and wider than float32 products are exact for."""
    wide = np.zeros(1500)
    wide[:1400] = 1.0
    data = [(0, [1e200, 1e199]), (1, [1.0, 0.1]), (2, [-1.0, 0.1]), (3, [1e-250, 1e-251]), (4, wide.tolist()), (5, (wide * 3).tolist()), (6, [float("inf"), 1.0]), (7, [float("nan"), 1.0]), (8, None), (9, [0.0, 0.0])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(d).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (2, 0), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_mix_of_rows_that_differ_elsewhere(spark):
    """Rows of one id and text: the same ones are taken whatever the layout."""
    rows_ = [(7, "one two three", "en", "s0", i) for i in range(40)] + [(i, prose(i, 20), "en", "s1", 0) for i in range(100, 140)]
    d = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    one, two = (sorted(map(str, source_mix.sample_mix(x).collect())) for x in (d.repartition(3), d.orderBy(F.desc("n_chars")).coalesce(1)))
    assert one == two
