import itertools
import random
import re

from eralex.llm import leakage as L


def brute(docs, items, n):
    grams = lambda t: {tuple(w[i : i + n]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - n + 1)}
    return sorted({(d, i) for d, t in docs if t for i, _, p in items if p and grams(t) & grams(p)})


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    items = [(f"i{k}", "q", " ".join(r.choice(vocab) for _ in range(r.randint(3, 20)))) for k in range(15)] + [("none", "q", None), ("twin", "a", None)]
    items[-1] = ("twin", "a", items[0][2])
    docs = [(k, " ".join(r.choice([*vocab, "zz", "Q, q"]) for _ in range(r.randint(0, 80)))) for k in range(120)] + [(900, None), (901, "")]
    docs += [(1000 + k, "Lead " + items[k][2].upper().replace(" ", " -- ") + " tail") for k in range(10)] + [(1000, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("doc_id", "text", "'x' as item_id", "1 as n_words")
    got = sorted((r.doc_id, r.item_id) for r in L.leaked_pairs(df, "doc_id", "text", items, 5).collect())
    assert got == brute(docs, items, 5)
    small = sorted((r.doc_id, r.item_id) for r in L.find_leaks(df, "doc_id", "text", items, 5, block_words=25).select("doc_id", "item_id").distinct().collect())
    assert small == got


def test_longest_match_and_places(spark):
    items = [("a", "question", "one two three four five six seven")]
    df = spark.createDataFrame([(1, "zero ONE two, three four five six eight one two three four")], "doc_id int, text string")
    got = [(r.doc_word, r.item_word, r.n_words) for r in L.find_leaks(df, "doc_id", "text", items, 4).collect()]
    assert sorted(got) == [(1, 0, 6), (8, 0, 4)]


def test_suffix_array_is_in_order():
    import numpy as np

    r = random.Random(3)
    for size, kinds in ((200, 3), (500, 2), (300, 40), (0, 2), (30, 1)):
        ids = np.array([r.choice(range(kinds + 1)) if kinds > 1 else 1 for _ in range(size)], np.uint32)
        whole = lambda p: tuple(itertools.takewhile(bool, ids[p:].tolist()))
        want = sorted(whole(p) for p in range(size) if len(whole(p)) >= 4)
        got = L.suffix_array(ids, 4).tolist()
        assert [whole(p) for p in got] == want and len(set(got)) == len(got)


def test_empty_sets(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    assert L.find_leaks(df, "doc_id", "text", [], 2).count() == 0
    assert L.find_leaks(df.where("false"), "doc_id", "text", [("i", "q", "a b c")], 2).count() == 0
    assert L.without_leaks(df, "doc_id", "text", [("i", "q", "b c")], 2).count() == 0


def test_long_text(spark):
    df = spark.createDataFrame([(1, "x " * 300_000 + "alpha beta gamma " + "y " * 10)], "doc_id int, text string")
    assert [(r.doc_word, r.n_words) for r in L.find_leaks(df, "doc_id", "text", [("i", "q", "alpha beta gamma")], 3).collect()] == [(300_000, 3)]
