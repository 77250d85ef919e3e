import random

import pytest

from eralex.llm import encoding as N

CLEAN = ["paid ₹5,000 under § 12 – see note", "the “Board” met at the café", "the firm’s façade was naïve", "Señor Pérez owns ½ acre at 30°", "(धारा 12) लागू है", "in the Château Â wing", "labelled «весы» here", "the port of SÃO TOMÉ", "column ├ of the form", "from Łódź, a city", "of 5 µm ± 2 each"]


def corpus(seed=0, n=600):
    r = random.Random(seed)
    return [f"{r.choice(CLEAN)} and {r.choice(CLEAN)} item {r.randint(1, 99)}" for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return N.train(N.count_runs(corpus()))


def fixed(model, t):
    parts, last = [], 0
    for a, b, shown in N.runs(t):
        chain, back = model.decide(shown)
        if back is not None:
            parts += [t[last:a], back]
            last = b
    return "".join([*parts, t[last:]])


def test_clean_text_stays(model):
    assert all(fixed(model, t) == t for t in CLEAN)
    assert all(model.decide(s)[0] == N.CLEAN for t in CLEAN for _, _, s in N.runs(t))


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252>utf-8>cp1252", "utf-8>mac-roman", "utf-8>cp437", "utf-8>cp850", "utf-8>cp1251", "cp1252>mac-roman"])
def test_round_trip_of_each_chain(model, chain):
    done = 0
    for t in corpus(9, 60):
        if chain.startswith("cp1252") and not all(ord(c) < 256 or c in "‘’“”–—₹" for c in t):
            continue
        if any(x in t for x in ("Château", "весы", "SÃO", "├", "Łódź", "₹")) and chain.startswith("cp1252"):
            continue
        g = N.garble(t, N.CHAINS[chain])
        if chain == "utf-8>cp1251" and ("�" in g or "\x98" in g):
            continue
        done += 1
        assert fixed(model, g) == t, (t, g)
    assert done > 3


def mixed(n, seed):
    """Clean texts, a tenth of them garbled: (stored, original)."""
    r = random.Random(seed)
    out = []
    for t in corpus(seed, n):
        g = N.garble(t, N.CHAINS[r.choice([c for c in N.CHAINS if c.startswith("utf-8") and c[-1] != "?"])]) if r.random() < 0.1 else t
        out.append((g, t))
    return out


@pytest.mark.parametrize("n", [60, 300, 3000])
def test_no_clean_mark_is_repaired_whatever_the_size(n):
    """Dashes, quotes and letters stay when few or many texts, garbled ones among them, are counted."""
    rows = mixed(n, n)
    model = N.train(N.count_runs([g for g, _ in rows]))
    held = corpus(n + 1, 400) + ["the authority at Torsa – vide notification", "from 1990 – 1995", "years 1990–95", "“Board” — so called", "a well–known rule"]
    kept = sum(fixed(model, t) == t and all(model.decide(s)[0] == N.CLEAN for _, _, s in N.runs(t)) for t in held)
    assert kept / len(held) >= 0.99
    bad = [(g, t) for g, t in rows if g != t]
    assert sum(fixed(model, g) != g or "\ufffd" in g for g, t in bad) / len(bad) >= 0.9


def test_dash_between_single_byte_encodings(model):
    """The same character is a clean dash between spaces and a garbled letter inside a word."""
    texts = corpus(1, 500) + ["the Señor spoke", "in España today", "a mañana rule"] * 30
    m = N.train(N.count_runs(texts))
    garbled = N.garble("the Señor spoke", N.CHAINS["mac-roman>cp1252"])
    assert "–" in garbled and fixed(m, garbled) == "the Señor spoke"
    assert fixed(m, "paid – see note") == "paid – see note"


def test_inversion_is_strict():
    assert N.invert("Ã", N.CHAINS["utf-8>cp1252"]) is None
    assert N.invert("é", N.CHAINS["utf-8>cp1252"]) is None
    assert N.invert("Ã©", N.CHAINS["utf-8>cp1252"]) == "é"


def test_operator(spark):
    texts = corpus(3, 300)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (1001, "", "x"), (1002, "ascii &mdash; only", "x"), (1003, "lost � here", "x"), (1004, N.garble(CLEAN[1], N.CHAINS["utf-8>cp1252"]), "x"), (1004, N.garble(CLEAN[1], N.CHAINS["utf-8>cp1252"]), "x"), (1005, "x " * 100_000 + N.garble("café", N.CHAINS["utf-8>cp437"]), "x")]
    got = {}
    for r in N.repair(spark.createDataFrame(rows, "ord int, text string, restored string"), "ord", "text").collect():
        got.setdefault(r.row_id, []).append(r)
    assert set(got) == {1003, 1004, 1005}
    assert len(got[1004]) == 2 and got[1004][0].restored == CLEAN[1] and got[1003][0].n_restored == 0 and got[1005][0].restored.endswith("café")
    assert N.repair(spark.createDataFrame([], "ord int, text string"), "ord", "text").count() == 0
