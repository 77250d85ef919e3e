import pytest

from eralex.llm import scans as S

BODY = "the tribunal with some hesitation accepted the ledger entries although the register was incomplete and the cross-examination of the eye-witness was not recorded"


@pytest.fixture(scope="module")
def lex():
    words = {w: 400 for w in BODY.replace("-", " ").split()} | {"charitable": 300, "trust": 300, "kulvani": 40, "bearing": 90, "hearing": 5_000, "korvarkar": 30, "korvorkar": 25, "material": 500, "ground": 500, "of": 900}
    return S.Lexicon(words, {"cross-examination": 50, "eye-witness": 50}, {"the register": 50}, 5)


def fix(lex, t, name=False):
    return S.repair_field(lex, t, name)


def test_misread_words(lex):
    for seen, true in (("reg!ster", "register"), ("lncomplete", "incomplete"), ("rnaterial", "material"), ("grouncl", "ground"), ("0f", "of"), ("hesitafion", "hesitation"), ("vvitness", "witness"), ("acccpted", "accepted")):
        assert fix(lex, f"the {seen} was here")[0] == f"the {true} was here", seen


def test_what_must_stay(lex):
    for t in ("bearing was taken", "Korvorkar and Korvarkar met", BODY, BODY.upper(), "write to kulvani12@mail.example now", "exhibit P-88 and section 51A", "12. The tribunal accepted", "a\nb\nc"):
        assert not any(fix(lex, t)[1:]), t


def test_cut_words_and_proper_hyphens(lex):
    assert fix(lex, "the regis-\nter was incom-\nplete")[:2] == ("the register was incomplete", 2)
    assert not any(fix(lex, "the cross-\nexamination of the eye-\nwitness")[1:])


@pytest.mark.parametrize("line", ["( 55 )", "P a g e 49", "...7", "18/29", "- 9 -", "[41]", "Pg. 25", "Page 37 of 44", "12", "346  Anil Kulvani v. Omkar Kul", "Anil Kulvani v. State of X    W.P.(C) 12/2020", "ANIL KULVANI V. STATE OF X"])
def test_page_lines(lex, line):
    got = fix(lex, f"the tribunal accepted\n{line}\nthe ledger entries")
    assert got[3] == 1 and line not in got[0]


def test_names(lex):
    for t, want in (("67 Tarun Kulvani v. X", "Tarun Kulvani v. X"), ("Anil v. Kulv-\nani", "Anil v. Kulvani"), ("A Trust v. B  Page 12", "A Trust v. B"), ("A Trust | p. 34", "A Trust"), ("Tru5t v. B", "Trust v. B")):
        assert fix(lex, t, True)[0] == want
    assert not any(fix(lex, "Unit 480 Textiles v. Ward No. 9 Trust", True)[1:])


def test_operator(spark):
    good = [(i, "d", BODY, "Kulvani Charitable Trust v. State") for i in range(80)]
    bad = [(900, "d", "the trlbunal accepted the led-\nger entries", "Kulvani Charitab1e Trust v. State"), (901, "d", None, None), (902, "d", "  ", ""), (900, "d", "the trlbunal accepted the led-\nger entries", "Kulvani Charitab1e Trust v. State"), (903, "d", (BODY + " ") * 3_000, None)]
    df = spark.createDataFrame(good + bad, "ord int, repaired string, text string, case_name string")
    got = sorted((r.row_id, r.field_name, r.repaired) for r in S.repair(df, "ord", ["text"], ["case_name"]).collect())
    assert got == sorted(2 * [(900, "text", "the tribunal accepted the ledger entries"), (900, "case_name", "Kulvani Charitable Trust v. State")])
    assert S.repair(df.where("false"), "ord", ["text"], ["case_name"]).count() == 0
