import random
import re
from collections import defaultdict

from eralex.llm import templates as M

SCHEMA = "ord int, doc string, court string, text string, leaf string, source string"


def brute(rows, letters=12, least=5, share=0.03):
    lines, docs, by = [], defaultdict(set), defaultdict(set)
    for o, d, c, t, *_ in rows:
        if d is None or not (c or "").strip():
            continue
        docs[c].add(d)
        for n, ln in enumerate((t.split("\n") if t is not None else []), 1):
            k = re.sub(r"[^a-zA-Zа-яéü#]", "", re.sub("[0-9]+", "#", re.sub("#", "", ln.lower())))
            if len(k.replace("#", "")) >= letters:
                lines.append((o, n, c, k))
                by[(c, k)].add(d)
    return sorted((o, n) for o, n, c, k in lines if len(by[(c, k)]) >= least and len(by[(c, k)]) >= share * len(docs[c]))


def made():
    r = random.Random(2)
    site = ["All rights reserved 2019", "*** Share  this page now ***", "Read more about tenants!", "short 12"]
    rows = []
    for i in range(400):
        lines = [f"unique sentence number {''.join(r.choice('abcdefghij') for _ in range(14))}" for _ in range(r.randint(0, 3))]
        for s in site:
            if r.random() < (0.1 if "Read" not in s else 0.02):
                lines.insert(r.randint(0, len(lines)), r.choice([s, s.upper(), s.replace("2019", str(r.randint(1, 3000))), s.replace(" ", "  ")]))
        rows.append((i, f"d{i // 2}" if r.random() < 0.95 else None, r.choice(["A", "A", "A", "B", None, " "]), "\n".join(lines) if r.random() < 0.97 else None, "x", "y"))
    return rows + rows[:20]


def test_against_brute_force(spark):
    rows = made()
    got = M.repeated_lines(spark.createDataFrame(rows, SCHEMA), "ord", "doc", "court", "text").collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


NAMES = "asha ravi meena tom lila omar jaya vikram sonia arjun farid gita".split()


def test_templates_and_removal(spark):
    rows = [(i, f"d{i}", "A", f"Body text of chunk {'abcdefghij'[i] * 3} here\nCertified that pages {i} to {i + 3} are in order", "x", "y") for i in range(8)] + [(90, "z", "A", None, "x", "y"), (91, "z", None, "kept", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    t = M.templates(df, "ord", "doc", "court", "text").collect()
    assert sorted((r.template, r.n_docs) for r in t) == [("body text of chunk <*> here", 8), ("certified that pages <*> to <*> are in order", 8)]
    clean = {r.row_id: (r.clean_text, r.n_removed) for r in M.without_repeated_lines(df, "ord", "doc", "court", "text").collect()}
    assert clean[0] == ("Body text of chunk aaa here", 1) and clean[90] == (None, 0) and clean[91] == ("kept", 0) and len(clean) == 10


def test_lines_that_differ_in_a_word_are_one_template_and_removed(spark):
    """Bylines with other names, at the lead and inside: none of them is repeated by itself."""
    rows = [(i, f"d{i}", "A", f"first {NAMES[i]} stands alone{'!' * i} as nobody {NAMES[-i]} wrote {NAMES[i] * 2}\n{NAMES[i].title()} reports for the legal desk\nPosted by {NAMES[i]} on the court blog", "x", "y") for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.template: (r.n_docs, r.n_lines) for r in M.templates(df, "ord", "doc", "court", "text").collect()}
    assert got["<*> reports for the legal desk"] == (12, 12) and got["posted by <*> on the court blog"] == (12, 12)
    gone = {(r.row_id, r.line_no) for r in M.covered_lines(df, "ord", "doc", "court", "text").collect()}
    assert {(i, n) for i in range(12) for n in (2, 3)} <= gone
    assert M.repeated_lines(df, "ord", "doc", "court", "text").count() == 0
    assert all("blog" not in r.clean_text for r in M.without_covered_lines(df, "ord", "doc", "court", "text").collect())


def test_lines_with_other_spaces_are_not_lost(spark):
    """Equal letters in other words: no spacing alone stands in enough documents."""
    forms = ["Share this page with friends", "Sharethis page with friends", "Share this pagewith friends", "SHARE THIS PAGE-WITH-FRIENDS", "Share th is page with friends"]
    rows = [(i, f"d{i}", "A", f, "x", "y") for i, f in enumerate(forms)]
    assert M.repeated_lines(spark.createDataFrame(rows, SCHEMA), "ord", "doc", "court", "text").count() == 5


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.repeated_lines(df, "ord", "doc", "court", "text").count() == 0
    assert M.without_repeated_lines(df, "ord", "doc", "court", "text").count() == 0
