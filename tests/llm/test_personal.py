import numpy as np
import pytest

from eralex.llm import personal as P
from eralex.llm import synthetic as S

#: Sentences that training has not seen, in words and order of their own.
HELD = {
    P.NAME: ["The surgeon who treated {n} has since retired.", "We met {n} outside the ration shop on {date}.", "A quarrel with {n} over the fence led to this suit.", "Neither {n} nor {n} filed a reply.", "The pension of {n} is withheld since {y}.", "At the identification parade {n} was pointed out.", "Ornaments pledged by {n} were melted.", "{n} alone attested the deed of gift.", "The tractor registered to {n} hit a culvert.", "He married {n} in {y}."],
    P.ADDRESS: ["The accused rented a room at {a} last winter.", "A search of {a} yielded nothing.", "The bride came from {a} to the temple.", "Her passport shows {a} as permanent abode."],
    P.PHONE: ["Dial {t} to complain.", "A missed call from {t} woke the guard.", "The tower log lists {t} eleven times.", "Helpline of the tenant: {t}."],
    P.EMAIL: ["All drafts were mailed to {e} first.", "Send your objections to {e} by Friday.", "Headers show {e} as the origin."],
    P.IDENTITY: ["His ration entry carries {i} as proof.", "The bank froze accounts linked with {i} in {y}.", "Verify {i} before renewal."],
    P.O: ["Justice {s} recused.", "The reference went to a Bench led by Justice {s}.", "Compensation of Rs. {m} was deposited by {f}.", "The ratio of {nn} v. {f} binds us.", "Appeal No. {k} of {y} abates.", "The godown of {f} caught fire on {date}.", "Stock of {b5} units was found short."],
}


@pytest.fixture(scope="module")
def model():
    return P.train()


def kinds(model, *texts):
    return [sorted({P.LABELS[y] for _, _, y in s}) for s in model.find(list(texts))]


def filled(maker, label):
    """A held-out sentence between others, and what it should give."""
    maker.text, maker.spans, maker.bits = "", [], []
    for pattern in ("{Lead} {say} ", maker.r.choice(HELD[label]), " {Lead} {say}"):
        maker._put(pattern, {})
    return maker.text, sorted({P.LABELS[y] for _, _, y in maker.spans})


def test_held_out_frames_and_names(model):
    """Recall and precision of each type on frames, names, places and numbers that training has not seen.

    The name list holds most of the names, as party columns do; without it two names of three are found.
    """
    maker = S.Maker(4711)
    names = np.zeros(1 << (P.LIST_BITS - 3), np.uint8)
    for which, words in enumerate((maker.listed_given, maker.listed_surnames)):
        for w in words:
            k = P._place(which, w)
            names[k >> 3] |= 1 << (k & 7)
    listed = model.with_names(names)
    bare = [filled(maker, P.NAME)[0] for _ in range(120)]
    assert sum("name" in g for g in kinds(model, *bare)) / 120 >= 0.6
    for label in HELD:
        texts, want = zip(*(filled(maker, label) for _ in range(120)))
        got = kinds(listed, *texts)
        if label == P.O:
            assert sum(bool(g) for g in got) <= 6
        else:
            name = P.LABELS[label]
            assert sum(name in g for g in got) / len(got) >= 0.9, (name, [t for t, g in zip(texts, got) if name not in g][:3])


def test_no_cases(model):
    texts = ["Justice Torvane had taken the same view.", "Kiran Torvane v. Usha Beldesh    W.P.(C) 12/2019", "The tender reference was TR-6656466564.", "The consignment weighed 72045045 grams.", "The amount of Rs. 797,553 had already been deposited.", "Torvane Charitable Trust", "M/s Beldesh Brothers", "", " \n", None, "plain words"]
    assert kinds(model, *texts) == [[] for _ in texts]


def test_a_weak_context_is_decided_by_skip_edges(model):
    """The last sentence fits persons and things; mentions far before it decide it, in the same spelling or a similar one."""
    far = " It rained for a week and the clerk kept the ledger in a dry room." * 30
    blind = P.Crf(model.weights, model.chain, np.zeros_like(model.skip))
    maker, only, lost, similar = S.Maker(8), 0, 0, 0
    for _ in range(40):
        first, last = maker.given()[0], maker.surname()[0]
        weak = "The list was read out. Then came {} with a delay."
        lead = f"My client {first} {last} never paid. The bail of {first} {last} was cancelled. A nurse told {first} {last} to leave." + far + " "
        at = lambda m, t, k: any(a <= k < b and y == P.NAME for a, b, y in m.find([t])[0])
        text = lead + weak.format(f"{first} {last}")
        place = len(lead) + weak.index("{")
        with_, without = at(model, text, place), at(blind, text, place)
        only, lost = only + (with_ and not without), lost + (without and not with_)
        spelled = lead + weak.format(f"{first[:2]}{first[1:]} {last[:-1]}{last[-1]}{last[-1]}")
        similar += at(model, spelled, place) and not at(blind, spelled, place)
    assert only >= 15 and lost == 0 and similar >= 10, (only, lost, similar)


def test_skip_edges_link_repeated_and_similar_tokens(model):
    types, doc, _, _, _ = model.stream(["Kelvane spoke. Later Kelvane and Ke1vaane left.", "Kelvane"])
    edges, kind = P.skip_edges(doc, model.attr.a[types])
    assert len(edges) == 2 and sorted(kind) == [0, 1]


def test_settled_tokens_do_not_change_the_labels(model):
    """Messages over all tokens and over the open ones alone agree."""
    maker = S.Maker(99)
    types, doc, _, _, edge = model.stream([maker.document()[0] for _ in range(150)])
    unary = model.potentials(types, edge)
    edges, kind = P.skip_edges(doc, model.attr.a[types])
    left = np.flatnonzero((types[:-1] > 0) & (types[1:] > 0))
    whole = P.messages(unary.astype(float), model.chain, left, edges, model.skip[kind], 12)[0].argmax(1)
    few = model.label(unary, types, doc)
    real = types > 0
    assert (whole[real] != few[real]).mean() < 0.001


def test_operator(spark, model):
    t = "My client Kiran Torvane never owned it. Write to a.b@mail.example.org for a copy."
    rows = [(1, t, "x"), (2, None, "x"), (3, "", "x"), (1, t, "x"), (4, "word " * 50_000 + t, "x")]
    df = spark.createDataFrame(rows, "ord int, text string, redacted string")
    got = {}
    for r in P.redact(df, "ord", ["text"], model).collect():
        got.setdefault(r.row_id, []).append(r)
    assert set(got) == {1, 4} and len(got[1]) == 2
    assert got[1][0].redacted == "My client [NAME] never owned it. Write to [EMAIL] for a copy." and got[1][0].pii_types == ["email", "name"]
    assert got[4][0].redacted.endswith("My client [NAME] never owned it. Write to [EMAIL] for a copy.")
    assert P.redact(df.where("false"), "ord", ["text"], model).count() == 0


def test_name_field_holds_every_name(spark):
    rows = [("Zubin Torvane", None), ("  Farah Beldesh", "State of X"), ("", None)]
    names = P.name_field(spark.createDataFrame(rows, "a string, b string"), ["a", "b"])
    assert [P._listed(names, i, w) for i, w in ((0, "zubin"), (1, "torvane"), (0, "farah"), (1, "beldesh"), (0, "torvane"), (1, "nobody"))] == [True] * 4 + [False] * 2
    assert not P.name_field(spark.createDataFrame([], "a string, b string"), ["a", "b"]).any()
