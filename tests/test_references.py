import datetime as dt
import random

from eralex.operators import references as R

CITES = "id bigint, a string, b string, at timestamp, key string"
RECS = "jid string, s timestamp, u timestamp"


def t(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)


def brute(cites, recs):
    out = set()
    for i, a, b, at, _ in cites:
        for c, v in (("a", a), ("b", b)):
            k = (v or "").strip(" ").upper()
            if k and not any((r[0] or "").strip(" ").upper() == k and r[1] and at and r[1] <= at and (r[2] is None or r[2] > at) for r in recs):
                out.add((i, c))
    return out


def found(spark, cites, recs):
    c, r = spark.createDataFrame(cites, CITES), spark.createDataFrame(recs, RECS)
    return sorted((x.row_id, x.ref_column) for x in R.orphan_references(c, "id", ["a", "b"], "at", r, "jid", "s", "u").collect())


def test_against_brute_force(spark):
    rng = random.Random(3)
    keys = ["k1", " K1 ", "k2", "K3", "", None, "k9"]
    cites = [(i, rng.choice(keys), rng.choice(keys), None if rng.random() < 0.05 else t(rng.randint(0, 400)), "x") for i in range(300)]
    recs = []
    for _ in range(30):
        s = rng.randint(0, 300)
        recs.append((rng.choice(["k1", "K2 ", "k3", None]), None if rng.random() < 0.1 else t(s), None if rng.random() < 0.4 else t(s + rng.randint(-50, 120))))
    assert found(spark, cites, recs) == sorted(brute(cites, recs))


def test_bounds_hot_key_and_repeats(spark):
    recs = [("K", t(10), t(20))]
    cites = [(1, "k", None, t(10), ""), (2, "k", None, t(20), ""), (3, "k", None, t(9), ""), (4, "k", None, None, "")] + [(i, "k", "", t(15), "") for i in range(5, 400)] + [(3, "k", None, t(9), "")]
    assert found(spark, cites, recs) == [(2, "a"), (3, "a"), (3, "a"), (4, "a")]


def test_a_hot_key_in_one_day(spark):
    """A landmark takes most references within one day, while its record comes and goes."""
    rng = random.Random(9)
    lives = [("hot", t(h / 10), t(h / 10 + 0.05)) for h in range(200)] + [("cold", t(0), None)]
    cites = [(i, "hot" if i % 10 else "cold", "Hot ", t(rng.randint(0, 2400) / 100), "") for i in range(3000)]
    assert found(spark, cites, lives) == sorted(brute(cites, lives))


def test_lifetimes_merge_and_do_not_overlap(spark):
    rows = [("k", t(0), t(10)), ("K ", t(5), t(50)), ("k", t(50), t(60)), ("k", t(90), None), ("k", t(95), t(99)), ("k", t(7), t(7)), ("z", None, t(3))]
    got = R.lifetimes(R.existence_deltas(spark.createDataFrame(rows, RECS), "jid", "s", "u")).orderBy("since").collect()
    assert [(r.key, r.since, r.until) for r in got] == [("K", t(0), t(60)), ("K", t(90), None)]


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [(1, "k", None, t(1), "")], []) == [(1, "a")]


def test_state_is_incremental(spark):
    ref = lambda rows: R.references(spark.createDataFrame(rows, CITES), "id", ["a"], "at")
    delta = lambda rows: R.existence_deltas(spark.createDataFrame(rows, RECS), "jid", "s", "u")
    first = R.signed_state(delta([("k1", t(0), None)]), ref([(1, "k1", None, t(1), ""), (2, "k2", None, t(1), "")]))
    assert {r.key for r in R.current_orphans(first).collect()} == {"K2"}
    second = R.merge_state(first, R.signed_state(delta([("k2", t(2), None)]), ref([(3, "k3", None, t(3), "")])))
    assert {(r.key, r.refs) for r in R.current_orphans(second).collect()} == {("K3", 1)}


def test_report_counts(spark):
    c = spark.createDataFrame([(1, "k", "z", t(1), ""), (2, "k", "z", t(1000), ""), (3, "q", None, t(1000), "")], CITES)
    r = spark.createDataFrame([("k", t(0), None)], RECS)
    got = {(x.ref_column, x.month): (x.n_references, x.n_orphans, x.n_orphan_keys) for x in R.orphan_report("c", c, ["a", "b"], "at", r, "jid", "s", "u").collect()}
    assert got == {("a", "2020-01"): (1, 0, 0), ("a", "2020-02"): (2, 1, 1), ("b", "2020-01"): (1, 1, 1), ("b", "2020-02"): (1, 1, 1)}
