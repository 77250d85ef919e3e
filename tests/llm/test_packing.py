import random
from collections import defaultdict

from eralex.llm import packing as P


def test_counts_are_exact():
    c = P.Counter(P.TOKENIZER)
    for t in ["a", " lead", "trail ", "two  spaces", "a\n b \nc\n\nd", "tab\there", "नमस्ते दुनिया 123", "don't stop", "x" * 3_000, "a   \n  b", "<|endoftext|> x", "\n"]:
        assert c.count(t) == c.whole(t), t
    assert c.count("") == 0


def test_fill_rules():
    r = random.Random(1)
    for _ in range(30):
        cap = r.choice([50, 1024])
        sizes = [r.randint(1, cap) for _ in range(r.randint(1, 120))]
        parts = P.fill(sizes, cap)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in p) <= cap for p in parts)
    sizes = [r.randint(20, 300) for _ in range(400)]
    assert sum(sizes) / (1024 * len(P.fill(sizes, 1024))) > 0.96
    assert P.fill([5], 5) == [[0]]


def test_differencing_balances():
    parts = P.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]
    parts = P.difference(list(range(1, 41)), 4)
    assert max(sum(i + 1 for i in p) for p in parts) - min(sum(i + 1 for i in p) for p in parts) <= 4


def test_operator(spark):
    rows = [(i, "word " * (i % 50 + 1), "x") for i in range(300)] + [(900, "long " * 700, "x"), (901, None, "x"), (902, "", "x"), (0, "word ", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, pack string")
    got = P.pack(P.token_counts(df, "doc_id", "text"), {"s": 100, "m": 400}, windows=8).collect()
    fill = defaultdict(int)
    for r in got:
        fill[(r["pack"], r.container_id)] += r.n_tokens
        assert r.piece_no == 0 or r.doc_id == 900
    assert all(v <= {"s": 100, "m": 400}[k[0]] for k, v in fill.items())
    counts = {r.doc_id: r.n_tokens for r in P.token_counts(df.where("doc_id = 900"), "doc_id", "text").collect()}
    pieces = sorted((r.start_token, r.n_tokens) for r in got if r["pack"] == "s" and r.doc_id == 900)
    assert sum(n for _, n in pieces) == counts[900] and all(n == 100 for _, n in pieces[:-1])
    assert sum(r["pack"] == "s" and r.doc_id == 0 for r in got) == 2 and not any(r.doc_id in (901, 902) for r in got)


def test_containers_do_not_depend_on_the_layout(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 60), r.randint(1, 90)) for _ in range(400)]
    runs = []
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id int, n_tokens long").repartition(parts)
        runs.append(sorted(tuple(x) for x in P.pack(df, {"s": 100}, windows=8).collect()))
        rows.reverse()
    assert runs[0] == runs[1] and len(runs[0]) == 400


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id int, text string")
    assert P.pack(P.token_counts(df, "doc_id", "text"), {"s": 100}).count() == 0
