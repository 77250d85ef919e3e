import random

import pytest

from eralex.llm import abuse as A

PLAIN = ["The tribunal accepted the ledger entries.", "The appellant relied upon the sale deed because the delay was explained.", "The threat to kill was not proved.", 'The witness said he had shouted "you worthless clown" at him.', "Section 12 did not apply.", "The register at the office showed a contrary figure."]
BAD = ["get lost you worthless clown!", "shut up, idiot, before someone shuts you up.", "you stinking moron, nobody wants you here.", "they are thieves by blood and should be driven out!"]


def made(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = [r.choice(PLAIN) for _ in range(r.randint(2, 8))]
        y = int(r.random() < 0.2)
        if y:
            s.insert(r.randint(0, len(s)), r.choice(BAD))
        out.append((" ".join(s), y if r.random() > 0.03 else 1 - y, y))
    return out


@pytest.fixture(scope="module")
def model():
    d = made(500, 1)
    return A.train([t for t, _, _ in d], [y for _, y, _ in d])


def test_held_out_accuracy(model):
    d = made(400, 2)
    s, _ = model.score([t for t, _, _ in d])
    assert sum((p > 0.5) == bool(y) for p, (_, _, y) in zip(s, d)) / len(d) > 0.98


def test_disguises(model):
    bad = ["get lost you w0rthle$$ clown!", "GET LOST YOU WORTHLESS CLOWN", "shut up, i d i o t, before someone shuts you up.", "shut up, idiiiiot, before someone shuts you up.", "you stinking m.o.r.o.n, nobody wants you here."]
    assert (model.score(bad)[0] > 0.5).all()
    assert (model.score(PLAIN + ["", None])[0] < 0.5).all()


def test_words():
    assert [A.plain_word(w) for w in ("m0r0n!", "“Clown”", "10,632", "P-430", "d*****g", "t.h.i.e.v.e.s", "veeeermin", "...", "29.08.2003")] == ["moron", "clown", "0", "p-0", "d*g", "thieves", "vermin", "", "0"]


def test_operator(spark):
    d = made(300, 3)
    docs = spark.createDataFrame([(i, t, "s", "x") for i, (t, _, _) in enumerate(d)] + [(900, None, "s", "x"), (901, "", None, "x"), (902, "word " * 40_000 + BAD[0], "s", "x"), (902, BAD[0], "s", "x")], "doc_id int, text string, source string, __text string")
    votes = spark.createDataFrame([(i, "a", y) for i, (_, y, _) in enumerate(d)] + [(0, "b", None), (1, "b", 1 - d[1][1])], "doc_id int, rater string, flagged int")
    m = A.fit(docs.drop("__text"), "doc_id", "text", votes, "doc_id", "flagged")
    got = A.score(docs.drop("__text"), m, ["doc_id", "source"], "text").collect()
    assert len(got) == 304 and {r.doc_id for r in got if r.score > 0.5} >= {902} and [r.score for r in got if r.doc_id in (900, 901)] == [0.0, 0.0]
    rates = {r.source: r.n_documents for r in A.rates(A.score(docs.drop("__text"), m, ["doc_id", "source"], "text"), "source").collect()}
    assert rates == {"s": 303, None: 1}
    none = A.fit(docs.drop("__text"), "doc_id", "text", votes.where("false"), "doc_id", "flagged")
    assert {r.score for r in A.score(docs.drop("__text"), none, ["doc_id"], "text").collect()} == {0.0}
    assert A.score(docs.where("false").drop("__text"), m, ["doc_id"], "text").count() == 0
