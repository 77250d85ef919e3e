import random

from eralex.llm import chunking as C
from eralex.llm.words import NON_SPACE


def words(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
        out.append(w.title() if i and out[-1][-1] == "." or not i else w)
        if r.random() < 0.07:
            out[-1] += "."
        elif r.random() < 0.05:
            out[-1] += ","
    return out


def rebuilt(text, found, overlap):
    spans = NON_SPACE.findall(text)
    out = []
    for k, (s, e, *_) in enumerate(found):
        out += spans[s + (overlap if k else 0) : e]
    return out == spans


def test_limits_overlap_and_round_trip():
    for n, limit, overlap in ((513, 512, 64), (5_000, 512, 64), (200_000, 512, 64), (100, 20, 5), (40, 10, 0)):
        text = " ".join(words(n))
        found = C.cuts(text, limit, overlap)
        assert all(e - s <= limit for s, e, *_ in found) and rebuilt(text, found, overlap)
        assert all(b[0] == a[1] - overlap for a, b in zip(found, found[1:]))
        if n >= 5_000:
            assert all(x[2] == "sentence" for x in found[:-1])


def test_no_boundaries_at_all():
    text = "\xa0".join(["w"] * 1_000)
    found = C.cuts(text, 512, 64)
    assert len(found) == 3 and all(e - s <= 512 for s, e, *_ in found) and rebuilt(text, found, 64)


def test_an_edit_changes_only_its_neighbours():
    w = words(20_000, 4)
    a = [" ".join(w)[x[3] : x[4]] for x in C.cuts(" ".join(w), 512, 64)]
    w[10_000:10_000] = ["Inserted", "words", "here."]
    b = [" ".join(w)[x[3] : x[4]] for x in C.cuts(" ".join(w), 512, 64)]
    assert len(set(b) - set(a)) <= 8 < len(b)


def test_operator(spark):
    long = " ".join(words(600))
    rows = [(1, long, "x"), (2, None, "x"), (3, "  ", "x"), (4, " ".join(["w"] * 512), None), (1, long, "x"), (5, "a" * 5_000, "x")]
    df = spark.createDataFrame(rows, "ord int, text string, piece_text string")
    got = C.split_oversized(df, "text", 512, 64, ["ord", "piece_text"]).collect()
    assert {r.ord for r in got} == {1} and len(got) == 4 and got[0].n_pieces == 2
    assert C.split_oversized(df.where("false"), "text", 512, 64, ["ord"]).count() == 0
