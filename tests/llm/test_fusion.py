import datetime as dt
import random
from collections import Counter

from pyspark.sql import functions as F

from eralex.llm import fusion as U

SCHEMA = "id bigint, cnr string, feed string, title string, day string, seen timestamp, key string, value string"
NOW = dt.datetime(2024, 6, 1)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fields = {"title": F.upper("title"), "day": U.valid_date("day", "seen")}
    return {r.key: r for r in U.fuse(df, "cnr", "id", "feed", "day", "seen", ["title", "cnr", "day"], fields).collect()}


def both(df, fields):
    key = U.group_key("cnr")
    return U.grouped(df, U.standing(df, key, "id", "day", "seen", ["title"]), key, "feed", "seen", fields)


def test_standing_record(spark):
    rows = [
        (3, "ab-1", "x", "T", "2020-01-01", NOW, "", ""), (5, "AB1", "y", None, "02-01-2020", NOW, "", ""), (7, " a b 1", "y", "T", "2030-01-01", NOW, "", ""), (9, "AB1", "y", "T", "02-01-2020", NOW, "", ""),
        (8, "AB1", "y", "T", "2020-01-02T00:00:00", NOW - dt.timedelta(1), "", ""), (1, None, "x", "T", "2020-01-01", NOW, "", ""), (2, "--", "x", "T", "2020-01-01", NOW, "", ""), (4, "Z9", "x", "T", "2020-01-01", NOW, "", ""),
    ]
    got = run(spark, rows)
    assert set(got) == {"AB1", "Z9"} and got["AB1"].day in ("02-01-2020", "2020-01-02T00:00:00") and (got["Z9"].best_rec_id, got["Z9"].n_records, got["Z9"].title, got["Z9"].day) == (4, 1, "T", "2020-01-01")
    assert (got["AB1"].group_rec_id, got["AB1"].best_rec_id, got["AB1"].n_records) == (3, 9, 5)
    twins = run(spark, [(2, "q", "x", None, None, NOW, "", ""), (1, "q", "x", None, None, NOW, "", "")])
    assert twins["Q"].best_rec_id == 1 and twins["Q"].title is None and twins["Q"].day is None


def test_copies_are_discounted(spark):
    """Two sources that share their mistakes are outvoted by two independent ones."""
    r = random.Random(1)
    rows, n = [], 0
    for k in range(300):
        truth = f"t{k}"
        wrong = f"wrong{k}" if r.random() < 0.4 else truth
        for feed in ("a", "b", "copy1", "copy2", "copy3"):
            v = wrong if feed.startswith("copy") else truth if r.random() < 0.9 else f"slip{k}{feed}"
            rows.append((n, f"K{k}", feed, v, None, NOW, "", ""))
            n += 1
    got = run(spark, rows)
    right = sum(got[f"K{k}"].title == f"t{k}" for k in range(300))
    assert right > 270


def test_vote_and_dependence():
    a = {"x": 0.9, "y": 0.9}
    assert U.vote("x\x1fy", a, {}) > U.vote("x\x1fy", a, {("x", "y"): 1.0}) > U.vote("x", a, {})
    assert U.copy_probability(10, 10, 0, 0.8, 0.8) > 0.99 > 0.5 > U.copy_probability(10, 0, 10, 0.8, 0.8)


def test_planted_copies_are_detected_and_posteriors_are_probabilities(spark):
    """A feed that copies nine of ten values of a poor one is found; independent feeds are not; posteriors hold what they promise."""
    r = random.Random(7)
    accuracy, rows, truth = {"good": 0.9, "fair": 0.8, "poor": 0.6}, [], {}
    for k in range(400):
        truth[f"K{k}"] = f"T{k}"
        said = {f: f"T{k}" if r.random() < a else f"{r.choice('UVWXYZABCD')}{k}" for f, a in accuracy.items()}
        said["copier"] = said["poor"] if r.random() < 0.9 else f"T{k}"
        rows += [(len(rows) + i, f"K{k}", f, v, None, NOW, "", "") for i, (f, v) in enumerate(said.items())]
    df = spark.createDataFrame(rows, SCHEMA)
    fields = {"title": F.upper("title")}
    acc, dep = U.estimate(U.patterns(both(df, fields)))
    assert dep[("copier", "poor")] > 0.99 and max(v for k, v in dep.items() if k != ("copier", "poor")) < 0.01
    assert acc["good"] > acc["fair"] > acc["poor"]
    got = U.fuse(df, "cnr", "id", "feed", "day", "seen", ["title"], fields).collect()
    right = [g.title == truth[g.key] for g in got]
    votes = sum(max(Counter(x[3] for x in rows if x[1] == k).items(), key=lambda c: (c[1], c[0]))[0] == t for k, t in list(truth.items())[:400])
    assert sum(right) > votes and abs(sum(g.min_posterior for g in got) / len(got) - sum(right) / len(got)) < 0.08


def test_any_number_of_sources_and_a_hot_group(spark):
    rows = [(i, "hot", f"feed{i % 90}", f"value {i % 7}", "2020-01-01", NOW, "", "") for i in range(3000)] + [(5000 + i, f"k{i}", "feed1", None, None, NOW, "", "") for i in range(5)]
    got = run(spark, rows)
    assert got["HOT"].n_records == 3000 and got["HOT"].best_rec_id == 0 and len(got) == 6


def brute(rows, accuracy):
    """Independent sources of one known accuracy: the value with the most sources."""
    by = {}
    for i, cnr, feed, title, *_ in rows:
        if title:
            by.setdefault(cnr.upper(), {}).setdefault(title.upper(), [set(), 0, title])[0].add(feed)
            by[cnr.upper()][title.upper()][1] += 1
    return {k: max(v.values(), key=lambda x: (len(x[0]), x[1], x[2]))[2] for k, v in by.items()}


def test_against_brute_force_with_equal_sources(spark):
    r = random.Random(4)
    rows = [(i, f"k{r.randint(0, 40)}", r.choice("abcde"), r.choice([None, "", "V1", "V2", "V3"]), None, NOW, "", "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = both(df, {"title": F.upper("title")}).collect()
    want = brute(rows, 0.8)
    for g in groups:
        if g["items"]:
            post = {s: p for s, _, p in U.posteriors(U.pattern_of([(x.sources, x.n_values) for x in g["items"]]), dict.fromkeys("abcde", 0.8), {})}
            assert max((round(post[x.sources], 9), x.n, x.shown) for x in g["items"])[2] == want[g.key]


def test_empty(spark):
    assert run(spark, []) == {}
