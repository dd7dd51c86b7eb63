"""Large lexicons: the automaton and the gram index against plain search."""

import random

from pyspark.sql import functions as F

from veriscope.operators import automaton as M
from veriscope.operators.classify import lexicon_match


def test_automaton_against_plain_search():
    rng = random.Random(2)
    for letters in ("ab", "abcdefghé ", "xyz 日-"):
        terms = list(dict.fromkeys("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(150)))
        texts = ["".join(rng.choice(letters + "q") for _ in range(rng.choice([0, 3, 40, 2000]))) for _ in range(60)]
        got = M.first_terms(texts, M.compile_terms(terms))
        assert [int(x) for x in got] == [next((i for i, t in enumerate(terms) if t in x), M.NONE) for x in texts]


def test_word_boundaries():
    terms = ["art", "rt", "a b", "-x", "é"]
    texts = ["party art", "art", "arts", "smart rt.", "a b", "ba b", "a -x b", "a-x", "caf é", "café", "", "z" * 2000 + " art " + "z" * 600, "z" * 509 + " art", "z" * 512 + "art"]
    got = M.first_terms(texts, M.compile_terms(terms), word_boundary=True).tolist()
    assert got == [0, 0, M.NONE, 1, 2, M.NONE, M.NONE, 3, 4, M.NONE, M.NONE, 0, 0, M.NONE]


def test_fifty_thousand_terms(spark):
    """Both ways equal brute force on 50,000 terms, and neither compares every text with every term."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(4, 9)))
    terms = list(dict.fromkeys([word() for _ in range(49_500)] + [word() + " " + word() for _ in range(600)] + ["zq", "z", "ABC d"]))
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.1 else word() for _ in range(8)) for _ in range(150)] + ["", None, "Z", "quiz", "abc D"]
    lexicon = spark.createDataFrame([(i // 3, t, ["HIGH", "MEDIUM", "LOW"][i % 3] if i % 7 else "MEDIUM") for i, t in enumerate(terms)], "priority int, term string, risk_level string")
    ranked = sorted((level != "HIGH", i // 3, t) for i, t in enumerate(terms) for level in [["HIGH", "MEDIUM", "LOW"][i % 3] if i % 7 else "MEDIUM"] if level != "LOW")
    want = [next((t for _, _, t in ranked if t.lower() in (x or "").lower()), None) for x in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    by_automaton, ranks = M.lexicon_match_large(d, lexicon), M.ranked_terms(lexicon)
    by_grams = M.match_by_grams(d, ranks, "text", False)
    for got in (by_automaton, by_grams):
        assert [r["matched_term"] for r in got.orderBy("i").collect()] == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_same_as_the_small_matcher(spark):
    rows = [(2, "badge", "MEDIUM"), (1, "Bad", "HIGH"), (1, "bad", "HIGH"), (3, "é", "MEDIUM"), (3, "low", "LOW"), (4, "a.b", "HIGH"), (9, "x", "MEDIUM")]
    lexicon = spark.createDataFrame(rows, "priority int, term string, risk_level string")
    d = spark.createDataFrame([(t,) for t in ("a bad one", "badge", "BADGES é", "caf é.", "a.b", "a.bc", "axb", "x", None, "", "low", "z" * 5000 + "bad")], "text string").withColumn("rank", F.lit(1))
    for whole in (False, True):
        same = [sorted(map(str, got.select("text", "matched_term", "lexicon_level", "rank").collect())) for got in (lexicon_match(d, lexicon, word_boundary=whole), M.lexicon_match_large(d, lexicon, word_boundary=whole), M.match_by_grams(d, M.ranked_terms(lexicon), "text", whole))]
        assert [x.replace("'bad'", "'Bad'") for x in same[0]] == [x.replace("'bad'", "'Bad'") for x in same[1]] == [x.replace("'bad'", "'Bad'") for x in same[2]]
    assert M.lexicon_match_large(d, lexicon.limit(0)).where("matched_term is not null").count() == 0
    assert M.lexicon_match_large(d.limit(0), lexicon).count() == 0 and M.match_by_grams(d, M.ranked_terms(lexicon.limit(0)), "text", False).count() == d.count()


def test_memory_does_not_grow_with_the_texts_of_a_batch(monkeypatch):
    import tracemalloc

    auto, text = M.compile_terms(["needle", "hay"]), "x" * 10_000
    tracemalloc.start()
    M.first_terms([text] * 4000, auto)  # 160 MB as code points
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    monkeypatch.setattr(M, "LETTERS_AT_ONCE", 12)
    assert M.first_terms(["", "a hay needle", "hay", "none", "x" * 30 + "hay", "", "needle"], auto).tolist() == [M.NONE, 0, 1, M.NONE, 1, M.NONE, 0]
    assert len(M.first_terms([], auto)) == 0
