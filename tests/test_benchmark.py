"""The evaluation queries against brute force over the whole document set: sections and judgment chunks."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from eralex.functions.text import STOPWORDS
from eralex.operators.validity import INVALIDATING
from eralex.plans import benchmark
from eralex.plans.ingest import clean_judgments

STOP = frozenset(STOPWORDS)


def _words(text, stop=frozenset()):
    return [w for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in stop]


def _vector(text):
    v = Counter()
    for w in _words(text):
        h = int(hashlib.sha256(w.encode()).hexdigest(), 16)
        v[h % 256] += -1 if h // 256 % 2 else 1
    size = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / size for k, x in v.items()} if size else {}


def _pools(docs, questions):
    """Per question the first 50 (score, place) of BM25 and of the vectors."""
    toks = [Counter(_words(x["full"], STOP)) for x in docs]
    n, avg = len(docs), sum(sum(t.values()) for t in toks) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in Counter(w for t in toks for w in t).items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    vecs = [_vector(x["full"]) for x in docs]
    norm = [1.5 * (0.25 + 0.75 * sum(t.values()) / avg) for t in toks]
    first = lambda scores: sorted(((s, i) for i, s in enumerate(scores)), key=lambda x: (-x[0], x[1]))[:50]
    for text in questions:
        q, qv = [w for w in _words(text, STOP) if w in raw], _vector(text)
        lex = [round(sum((raw[w] if raw[w] >= 0 else floor) * t[w] * 2.5 / (t[w] + k) for w in q), 6) + 0.0 for t, k in zip(toks, norm)]
        yield first(lex), first([round(sum(x * v.get(k, 0.0) for k, x in qv.items()), 6) + 0.0 for v in vecs])


@pytest.fixture(scope="module")
def world(spark, sf):
    t = lambda name: [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    corpus = sorted(t("corpus"), key=lambda r: r["ord"])
    have = {r["doc_id"] for r in corpus}
    docs = [{"id": r["doc_id"], "section": True, "statute": r["statute"], "jid": None, "full": " ".join(x for x in (r["marginal_note"], r["text"]) if x).strip()} for r in corpus]
    docs += [{"id": r["doc_id"], "section": r["source"] == "statute", "statute": r["statute"] or "", "jid": (r["judgment_id"] or "").strip().upper(), "full": r["text"] or ""} for r in sorted(t("dense_docs"), key=lambda r: r["ord"]) if r["source"] != "statute" or r["doc_id"] not in have]
    day = {r.judgment_id.strip().upper(): r.date for r in clean_judgments(spark, sf).collect()}
    bad = defaultdict(list)
    for c in t("citations"):
        a, b = ((c[k] or "").strip().upper() for k in ("cited_judgment_id", "citing_judgment_id"))
        if c["signal"] in INVALIDATING and a in day and b in day:
            bad[a].append(day[b])
    return docs, t("bench_items"), bad


def _wrong(doc, day, bad):
    if doc["section"]:
        return doc["statute"] != ("IPC" if str(day) < "2024-07-01" else "BNS")
    return any(x <= day for x in bad.get(doc["jid"], ()))


def _fixed(docs):
    for x in docs:
        w = x["full"].split()
        if len(w) <= 512:
            yield x
        else:
            yield from ({**x, "id": f"{x['id']}::w{k}", "full": " ".join(w[k * 512 : k * 512 + 512])} for k in range((len(w) - 1) // 512 + 1))


def _top(docs, pool, item, bad, on, digits):
    s = [(round(v * (0.05 if on and _wrong(docs[i], item["query_date"], bad) else 1.0), digits), i, r) for r, (v, i) in enumerate(pool)]
    s.sort(key=lambda x: (-x[0], not docs[x[1]]["section"] if on else 0, x[2]))
    return [docs[i] for _, i, _ in s[:10]]


def test_ablation_searches_sections_and_judgments(spark, sf, world):
    docs, items, bad = world
    want = {}
    for chunk, ds in (("structure_aware", docs), ("fixed_512", list(_fixed(docs)))):
        for item, (lex, den) in zip(items, _pools(ds, [x["question"] for x in items])):
            both = Counter()
            for pool in (lex, den):
                for r, (_, i) in enumerate(pool, 1):
                    both[i] += 1 / (60 + r)
            hyb = sorted(((round(v, 9), i) for i, v in both.items()), key=lambda x: (-x[0], x[1]))
            for name, pool in (("bm25", lex), ("dense", den), ("hybrid", hyb)):
                for on in (True, False):
                    want[chunk, name, "on" if on else "off", item["item_id"]] = [x["id"] for x in _top(ds, pool, item, bad, on, 9)]
    got = defaultdict(dict)
    for r in benchmark._ablated(spark, sf).collect():
        got[r.chunking, r.retriever, r.validity, r.query_id][r["rank"]] = r.doc
    assert set(got) == set(want)
    differ = [k for k in want if [got[k][r] for r in sorted(got[k])] != want[k]]
    assert not differ, (len(differ), differ[:5])
    found = {x for v in want.values() for x in v}
    assert any("::w" in x for x in found)  # long chunks are cut
    gold = {g for x in items if x["slice"] == "precedent" for g in x["gold_evidence_ids"]}
    assert gold & found


def test_era_of_a_judgment_is_wrong_not_missing(spark, sf):
    rows = {(r.chunking, r.retriever, r.validity): r.n_excluded for r in benchmark.ablation_grid(spark, sf).where("metric = 'era_ok'").collect()}
    no_era = spark.read.parquet(f"{sf}/bench_items.parquet").where("is_answerable and size(gold_evidence_ids) > 0 and coalesce(applicable_era, '') = ''").count()
    assert len(rows) == 12 and set(rows.values()) == {no_era}


def test_ir_metrics_rank_judgments_too(spark, sf, world):
    docs, items, bad = world
    want = {}
    for item, (lex, _) in zip(items, _pools(docs, [x["question"] for x in items])):
        gold = item["gold_evidence_ids"] or []
        if item["is_answerable"] and gold:
            at = [(r, x["id"]) for r, x in enumerate(_top(docs, lex, item, bad, True, 6), 1) if x["id"] in gold]
            ideal = sum(1 / math.log2(r + 1) for r in range(1, min(len(gold), 10) + 1))
            want[item["item_id"]] = (round(len({x for _, x in at}) / len(gold), 6), round(1 / at[0][0], 6) if at else 0.0, pytest.approx(sum(1 / math.log2(r + 1) for r, _ in at) / ideal, abs=1e-6))
    got = {r.query_id: (r.recall, r.mrr, r.ndcg) for r in benchmark.ir_metrics(spark, sf).collect()}
    assert got == want
    judged = {x["item_id"] for x in items if x["slice"] in ("precedent", "multihop")}
    assert any(got[k][0] > 0 for k in judged)


def _replicate_means(values, reps):
    """In Python's own integers, draw by draw."""
    n, m, f = len(values), 2_147_483_647, 48_271
    out = []
    for rep in range(reps):
        total = 0.0
        for i in range(n):
            x = (rep * 1000 + i + 1) * f % m
            x = (x * f + rep) % m
            total += values[(x * f + i) % m % n]
        out.append(round(total / n, 9))
    return out


def test_statistics_take_ten_thousand_replicates(spark, tmp_path):
    d = str(tmp_path)
    votes = [(r, f"d{i:02}", int(i * k % 7 < 2)) for r, k in (("a", 3), ("b", 5)) for i in range(20)]
    spark.createDataFrame(votes, "rater string, doc_id string, flagged int").write.parquet(f"{d}/review_labels.parquet")
    assert benchmark.REPS == 10_000
    got = {r.rater: (r["mean"], r.low, r.high, r.n) for r in benchmark.bootstrap_ci(spark, d).collect()}
    for rater in "ab":
        own = sorted(float(v) for r, _, v in votes if r == rater)  # a draw names a place in the order of values
        means = sorted(_replicate_means(own, 10_000))
        assert got[rater] == (round(sum(own) / 20, 6), round(means[250], 6), round(means[9749], 6), 20)
    by = {(r, i): v for r, i, v in votes}
    diff = sorted(float(abs(by["a", f"d{i:02}"] - by["b", f"d{i:02}"])) for i in range(20))
    obs = sum(diff) / 20
    p = sum(abs(m - obs) >= abs(obs) - 1e-12 for m in _replicate_means(diff, 10_000)) / 10_000
    row = benchmark.paired_bootstrap(spark, d).head()
    assert (row["diff"], row.p) == (round(obs, 6), pytest.approx(p, abs=1e-6))
