"""Queries of benchmark building, metrics, ablation and statistics, and their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralex.config import Settings
from eralex.functions import embedding as E
from eralex.functions.text import CLAIM_STOPWORDS, base_section
from eralex.operators import benchgen, chunking, faithfulness, fusion, metrics, sparse, validity
from eralex.operators.ingest import seeded_sample
from eralex.operators.references import key_of
from eralex.plans.ingest import clean_judgments
from eralex.plans.mapping import QA, TRUSTED, qa_pairs, section_mapping
from eralex.plans.retrieval import _ERA, _HEAD, ITEMS, sql_bm25, sql_dense, validity_topk
from eralex.plans.validity import EDGES, _edges, sql_good_law, validity_notices
from eralex.runtime import cut, table

TRAP_SECTIONS = [("IPC", "871"), ("IPC", "700Z"), ("BNS", "640"), ("CrPC", "777")]
TRAP_CASES = ["Harbour Lights Trust v. Moonlit Tramways (2020)", "Anand Kalpit v. State of Nowhere (2018)"]
REPS = 10_000


def bench_slices(s: SparkSession, d: str) -> DataFrame:
    i = benchgen.dated_items(qa_pairs(s, d))
    return i.select("item_id", "slice", "question", "query_date", "gold_answer", F.get("gold_evidence_ids", F.lit(0)).alias("gold"), "applicable_era")


def precedent_items(s: SparkSession, d: str) -> DataFrame:
    i = benchgen.precedent_items(clean_judgments(s, d), table(s, d, "dense_docs"), _edges(s, d))
    return i.select("item_id", "question", "query_date", F.get("gold_evidence_ids", F.lit(0)).alias("gold"), "good_law", "reason")


def multihop_items(s: SparkSession, d: str) -> DataFrame:
    i = benchgen.multihop_items(clean_judgments(s, d), table(s, d, "dense_docs"), _edges(s, d), section_mapping(s, d))
    return i.select("item_id", "question", "query_date", "gold_answer", F.array_join("gold_evidence_ids", ";").alias("gold"), "good_law")


def trap_items(s: SparkSession, d: str) -> DataFrame:
    return benchgen.trap_items(s, TRAP_SECTIONS, TRAP_CASES, "2025-01-01").select("item_id", "slice", "question", "query_date", "is_answerable", F.size("gold_evidence_ids").alias("n_gold"))


def item_problems(s: SparkSession, d: str) -> DataFrame:
    """The stored items, some of them twice, against the invariants."""
    b = table(s, d, "bench_items")
    return benchgen.item_problems(b.unionByName(b.where(F.col("item_id").endswith("7"))))


def slice_counts(s: SparkSession, d: str) -> DataFrame:
    """Items of every slice, empty ones included."""
    dim = s.createDataFrame([(x,) for x in [*benchgen.SLICES, "unknown"]], "slice string")
    return dim.join(table(s, d, "bench_items"), "slice", "left").groupBy("slice").agg(F.count("item_id").alias("n"), F.count(F.when(F.col("is_answerable"), 1)).alias("n_answerable"))


def _gold(s: SparkSession, d: str) -> DataFrame:
    """Answerable items with evidence."""
    b = table(s, d, "bench_items").where("is_answerable and size(gold_evidence_ids) > 0")
    return b.select(F.col("item_id").alias("query_id"), F.col("gold_evidence_ids").alias("gold"), F.coalesce("applicable_era", F.lit("")).alias("era"))


def _searched(s: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, statute, jid, full): every section of corpus, then the rest of dense_docs; doc_id leads with the order.

    A section that dense_docs repeats counts once, as corpus has it. Only the repeated sections meet
    the ids of corpus, so no judgment text is shuffled. A judgment is of no code: its statute is "".
    """
    corpus, dense = table(s, d, "corpus"), table(s, d, "dense_docs")
    section = F.coalesce(F.col("source") == "statute", F.lit(False))
    rest = dense.where(~section).unionByName(dense.where(section).join(corpus.select("doc_id"), "doc_id", "left_anti").select(*dense.columns))
    key = lambda part: F.concat_ws("|", F.concat(F.lit(part), F.lpad(F.col("ord").cast("string"), 12, "0")), "doc_id").alias("doc_id")
    own = corpus.select(key("0"), F.lit("statute").alias("source"), F.coalesce("statute", F.lit("")).alias("statute"), F.lit(None).cast("string").alias("jid"), F.trim(F.concat_ws(" ", F.nullif("marginal_note", F.lit("")), "text")).alias("full"))
    return own.unionByName(rest.select(key("1"), "source", F.coalesce("statute", F.lit("")).alias("statute"), key_of("judgment_id").alias("jid"), F.coalesce("text", F.lit("")).alias("full")))


def _lawful(s: SparkSession, d: str, seen: DataFrame, items: DataFrame) -> DataFrame:
    """Ranked documents with first (0 for sections) and lawful: the score, lowered for a section of the wrong code or a judgment no longer good law."""
    seen = cut(seen.join(items.select("query_id", "query_date"), "query_id"), "seen")
    judged = validity.good_law(seen, _edges(s, d), "jid", "query_date")
    section = F.coalesce(F.col("source") == "statute", F.lit(False))
    own = Settings.read(s)
    wrong = F.when(section, F.col("statute") != validity.statute_on("query_date", own.cut_over)).otherwise(~F.col("good_law"))
    return judged.withColumn("first", F.when(section, 0).otherwise(1)).withColumn("lawful", validity.demoted(F.col("score"), wrong, own.demotion))


def _doc(key: str) -> Column:
    return F.split_part(F.col(key), F.lit("|"), F.lit(2))


GRID = [(c, r, v) for c in ("structure_aware", "fixed_512") for r in ("bm25", "dense", "hybrid") for v in ("on", "off")]


def _ablated(s: SparkSession, d: str) -> DataFrame:
    """(chunking, retriever, validity, query_id, doc, statute, rank): all configurations as columns of one result.

    Each chunking is scored once; fusion and demotion derive the others from its pools. Of the grid the first
    ``max_configs`` configurations are kept.
    """
    own = Settings.read(s)
    b = table(s, d, "bench_items").withColumnRenamed("item_id", "query_id")
    whole = _searched(s, d)
    fixed = chunking.fixed_windows(whole, "doc_id", "full", own.chunk_words).select(F.col("chunk_doc_id").alias("doc_id"), "source", "statute", "jid", "full")
    out = None
    q = E.vectors(b, ["query_id"], "question", own.embedding_dim).withColumnRenamed("vec", "qv")
    for name, docs in (("structure_aware", whole), ("fixed_512", fixed)):
        lex = sparse.bm25(docs, "doc_id", "full", b, "query_id", "question", own.pool)
        lex = cut(lex.select("query_id", "doc_id", "score", "rank"), "pool")
        den = cut(E.search(E.vectors(docs, ["doc_id"], "full", own.embedding_dim), "doc_id", "vec", q, "query_id", "qv", own.pool).select("query_id", "doc_id", F.col("sim").alias("score"), "rank"), "pool")
        hyb = validity.rerank(fusion.rrf(lex, den, k=own.rrf_k), "score", "doc_id")
        lists = [x.select("query_id", "doc_id", "score", "rank", F.lit(r).alias("retriever")) for r, x in (("bm25", lex), ("dense", den), ("hybrid", hyb))]
        pools = reduce(DataFrame.unionByName, lists).withColumn("parent", metrics.parent_of(F.col("doc_id")))  # a window is of its text's source
        one = pools.join(whole.select(F.col("doc_id").alias("parent"), "source", "statute", "jid"), "parent").drop("parent").withColumn("chunking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    both = _lawful(s, d, out, b).withColumn("validity", F.explode(F.array(F.lit("on"), F.lit("off"))))
    on = F.col("validity") == "on"
    if len(GRID) > own.max_configs:
        both = both.where(F.concat_ws("/", "chunking", "retriever", "validity").isin(["/".join(g) for g in GRID[: own.max_configs]]))
    both = both.withColumn("score", F.round(F.when(on, F.col("lawful")).otherwise(F.col("score")), 9))
    w = W.partitionBy("chunking", "retriever", "validity", "query_id").orderBy(F.desc("score"), F.when(on, F.col("first")), "rank")
    return both.withColumn("new", F.row_number().over(w)).where("new <= 10").select("chunking", "retriever", "validity", "query_id", _doc("doc_id").alias("doc"), "statute", F.col("new").alias("rank"))


def ir_metrics(s: SparkSession, d: str) -> DataFrame:
    """Dated BM25 over sections and judgment chunks, against the evidence."""
    b = table(s, d, "bench_items").withColumnRenamed("item_id", "query_id")
    docs = _searched(s, d)
    pool = sparse.bm25(docs, "doc_id", "full", b, "query_id", "question", Settings.read(s).pool).join(docs.select("doc_id", "source", "statute", "jid"), "doc_id").withColumnRenamed("rank", "prior")
    shown = _lawful(s, d, pool, b).withColumn("lawful", F.round("lawful", 6))
    return metrics.ranking(validity.rerank(shown, "lawful", "first", "prior").withColumn("doc", _doc("doc_id")), _gold(s, d), 10)


CONFIG = ["chunking", "retriever", "validity"]


def _items_scored(s: SparkSession, d: str) -> DataFrame:
    return metrics.hit_metrics(_ablated(s, d).withColumn("fixed", F.col("chunking") == "fixed_512"), _gold(s, d), CONFIG)


def ablation_grid(s: SparkSession, d: str) -> DataFrame:
    return metrics.summary(_items_scored(s, d), CONFIG, ["hit5", "hit10", "rr", "dcg", "era_ok"])


def ablation_ci(s: SparkSession, d: str) -> DataFrame:
    return metrics.bootstrap_ci(_items_scored(s, d), CONFIG, "hit10", REPS)


def ablation_significance(s: SparkSession, d: str) -> DataFrame:
    """Validity on against off per chunking and retriever, with step-down correction."""
    i = _items_scored(s, d)
    diff = i.groupBy("chunking", "retriever", "query_id").agg((F.max(F.when(F.col("validity") == "on", F.col("hit10"))) - F.max(F.when(F.col("validity") == "off", F.col("hit10")))).alias("diff"))
    p = metrics.paired_bootstrap(diff, ["chunking", "retriever"], "diff", REPS)
    return metrics.holm(p.withColumn("test", F.concat_ws("/", "chunking", "retriever")), "test", "p")


def _era_scores(s: SparkSession, d: str) -> DataFrame:
    """Whether the first result is of the right code, naive and dated, per item."""
    from eralex.plans.retrieval import naive_topk

    b = table(s, d, "bench_items").select(F.col("item_id").alias("query_id"), "applicable_era").where("applicable_era <> ''")
    one = lambda df, m: df.where("rank = 1").join(b, "query_id").select("query_id", F.lit(m).alias("mode"), (F.col("statute") == F.col("applicable_era")).cast("int").alias("ok"))
    return one(naive_topk(s, d), "naive").unionByName(one(validity_topk(s, d), "validity"))


def era_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _era_scores(s, d).groupBy("mode").agg(F.round(F.avg("ok"), 6).alias("accuracy"), F.count("*").alias("n"))


def _exact_scores(s: SparkSession, d: str) -> DataFrame:
    """Whether the first result is the very section of the gold, naive and dated, per item whose first evidence is a section."""
    from eralex.plans.retrieval import naive_topk

    gold = F.get("gold_evidence_ids", F.lit(0))
    b = table(s, d, "bench_items").where("is_answerable and applicable_era <> ''").select(F.col("item_id").alias("query_id"), F.split_part(gold, F.lit("-"), F.lit(1)).alias("gold_statute"), base_section(F.split_part(gold, F.lit("-"), F.lit(2))).alias("gold_section"))
    b = b.where(F.col("gold_statute").isin("IPC", "BNS"))
    c = table(s, d, "corpus").select("ord", base_section("section_no").alias("section"))
    hit = lambda df: df.where("rank = 1").join(c, "ord").select("query_id", "statute", "section")
    right = F.coalesce((F.col("statute") == F.col("gold_statute")) & (F.col("section") == F.col("gold_section")), F.lit(False)).cast("int")
    one = lambda df, m: b.join(hit(df), "query_id", "left").select("query_id", F.lit(m).alias("mode"), right.alias("ok"))
    return one(naive_topk(s, d), "naive").unionByName(one(validity_topk(s, d), "validity"))


def exact_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _exact_scores(s, d)


def baseline_vs_validity(s: SparkSession, d: str) -> DataFrame:
    """Exact first hits, section and statute, of both modes and their difference in one row."""
    e = _exact_scores(s, d)
    of = lambda m: F.avg(F.when(F.col("mode") == m, F.col("ok")))
    return e.agg(F.round(of("naive"), 6).alias("naive"), F.round(of("validity"), 6).alias("validity"), F.round(of("validity") - of("naive"), 6).alias("delta"), F.count(F.when(F.col("mode") == "naive", 1)).alias("n"))


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "review_labels").where("flagged is not null").groupBy("rater", "doc_id").agg(F.max("flagged").alias("flagged"))


def bootstrap_ci(s: SparkSession, d: str) -> DataFrame:
    """Interval of the share of flagged documents per rater."""
    return metrics.bootstrap_ci(_flagged(s, d), ["rater"], "flagged", REPS)


def paired_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Difference between the highest and the lowest vote on a document."""
    v = table(s, d, "review_labels").where("flagged is not null").groupBy("doc_id").agg((F.max("flagged") - F.min("flagged")).alias("diff")).withColumn("set", F.lit("all"))
    return metrics.paired_bootstrap(v, ["set"], "diff", REPS)


P_VALUES = [("a", 0.072), ("b", 0.072), ("c", 0.27), ("d", 0.004), ("e", 0.6254), ("f", 0.009)]


def holm(s: SparkSession, d: str) -> DataFrame:
    return metrics.holm(s.createDataFrame(P_VALUES, "test string, p double"), "test", "p")


def _answers(s: SparkSession, d: str) -> DataFrame:
    """Answers made from the gold: each cites its first two results; traps abstain."""
    b = table(s, d, "bench_items")
    text = F.when(~F.col("is_answerable"), F.lit("The documents do not contain an answer.")).otherwise(
        F.concat(F.coalesce("gold_answer", F.lit("")), F.lit(" [Doc 1] "), F.when(F.col("applicable_era") == "IPC", F.lit("It has been repealed. [Doc 2] ")).otherwise(F.lit("")), "question", F.lit(" [Doc 9]"))
    )
    return b.select(F.col("item_id").alias("answer_id"), text.alias("answer"), F.col("applicable_era").alias("gold_statute"), F.split_part(F.coalesce(F.get("gold_evidence_ids", F.lit(0)), F.lit("-")), F.lit("-"), F.lit(2)).alias("gold_section"))


def _shown(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "corpus").select("ord", "section_no", "text")
    return validity_topk(s, d).where("rank <= 5").join(docs, "ord").select(F.col("query_id").alias("answer_id"), F.col("rank").alias("n"), "statute", "section_no", "text")


def claim_support(s: SparkSession, d: str) -> DataFrame:
    return faithfulness.claim_support(_answers(s, d), "answer_id", "answer", _shown(s, d))


def claim_faithfulness(s: SparkSession, d: str) -> DataFrame:
    return faithfulness.faithfulness(claim_support(s, d))


def citation_rates(s: SparkSession, d: str) -> DataFrame:
    n = validity_notices(s, d).select(F.col("query_id").alias("answer_id"), F.col("notices").alias("notice"))
    return faithfulness.answer_rates(_answers(s, d).join(n, "answer_id", "left"), _shown(s, d))


SAMPLE = 30


def sampled_rates(s: SparkSession, d: str) -> DataFrame:
    """The rates over a seeded sample of the answers."""
    n = validity_notices(s, d).select(F.col("query_id").alias("answer_id"), F.col("notices").alias("notice"))
    sample = seeded_sample(_answers(s, d), "answer_id", SAMPLE)
    return faithfulness.answer_rates(sample.join(n, "answer_id", "left"), _shown(s, d))


def prompts(s: SparkSession, d: str) -> DataFrame:
    r = _shown(s, d).withColumnRenamed("answer_id", "query_id").withColumnRenamed("n", "rank")
    q = table(s, d, "bench_items").select(F.col("item_id").alias("query_id"), "question")
    p = faithfulness.prompts(r, validity_notices(s, d), q)
    return p.select("query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


def trap_false_answers(s: SparkSession, d: str) -> DataFrame:
    """Share of unanswerable items that were answered all the same."""
    b = table(s, d, "bench_items").select(F.col("item_id").alias("answer_id"), "is_answerable", "slice")
    j = _answers(s, d).join(b, "answer_id").where("not is_answerable")
    return j.groupBy("slice").agg(F.round(F.avg((~F.lower("answer").contains("do not contain an answer")).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        bench_slices, precedent_items, multihop_items, trap_items, item_problems, slice_counts, ir_metrics, ablation_grid, ablation_ci, ablation_significance, era_accuracy, exact_accuracy, baseline_vs_validity, bootstrap_ci,
        paired_bootstrap, holm, claim_support, claim_faithfulness, citation_rates, sampled_rates, prompts, trap_false_answers,
    )
}

_HOLD = "fh AS (SELECT jid, arg_min(doc_id, ord) AS chunk_id, arg_min(text, ord) AS holding FROM (SELECT upper(trim(judgment_id)) AS jid, ord, doc_id, text FROM dense_docs WHERE rhetorical_unit = 'HOLDING' AND text IS NOT NULL) GROUP BY jid)"
_TOP = (
    _HEAD
    + sql_bm25("corp", 50)
    + f""", dm AS (SELECT query_id, doc_id, statute, section_no, rank AS prior, round(CASE WHEN statute <> {_ERA} THEN score * 0.05 ELSE score END, 6) AS score FROM pool JOIN corp USING (doc_id) JOIN items USING (query_id)),
top AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior)::INTEGER AS rank FROM dm) WHERE rank <= 10)"""
)
_BOOT = f"""ar AS (SELECT {{by}}, list(v::DOUBLE ORDER BY v) AS a, count(*) AS n, avg(v::DOUBLE) AS obs FROM sc0 GROUP BY {{by}}),
dr AS (SELECT {{by}}, n, obs, a, rep, unnest(range(n)) AS i FROM (SELECT *, unnest(range({REPS})) AS rep FROM ar)),
ix AS (SELECT {{by}}, n, obs, a, rep, (((((rep * 1000 + i + 1) * 48271) % 2147483647 * 48271 + rep) % 2147483647 * 48271 + i) % 2147483647) % n AS k FROM dr),
rp AS (SELECT {{by}}, rep, any_value(n) AS n, any_value(obs) AS obs, round(sum(a[k + 1]) / any_value(n), 9) AS mean FROM ix GROUP BY {{by}}, rep)"""
_CI = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY mean, rep) - 1 AS k FROM rp)
SELECT {{by}}, round(max(obs), 6) AS mean, round(max(CASE WHEN k = {int((1 - 0.95) / 2 * REPS)} THEN mean END), 6) AS low, round(max(CASE WHEN k = {int((1 - (1 - 0.95) / 2) * REPS) - 1} THEN mean END), 6) AS high, max(n) AS n FROM rk GROUP BY {{by}}"""


#: Sections of corpus, then the rest of dense_docs, with ids that lead with the order.
_SRCH = """srch AS (SELECT '0' || lpad(ord::VARCHAR, 12, '0') || '|' || doc_id AS doc_id, 'statute' AS source, coalesce(statute, '') AS statute, NULL::VARCHAR AS jid, trim(concat_ws(' ', nullif(marginal_note, ''), text)) AS "full" FROM corpus
  UNION ALL SELECT '1' || lpad(ord::VARCHAR, 12, '0') || '|' || doc_id, source, coalesce(statute, ''), nullif(upper(trim(judgment_id)), ''), coalesce(text, '') FROM dense_docs
  WHERE NOT coalesce(source = 'statute', false) OR NOT coalesce(doc_id IN (SELECT doc_id FROM corpus WHERE doc_id IS NOT NULL), false))"""


def _lawful_sql(seen: str) -> str:
    """CTEs up to ``lw``: ``seen`` (query_id, query_date, jid, source, statute, score) with lawful and first."""
    return f"""{sql_good_law(seen, "jid", "query_date")},
lw AS (SELECT *, CASE WHEN coalesce(source = 'statute', false) THEN 0 ELSE 1 END AS first,
  CASE WHEN coalesce(CASE WHEN coalesce(source = 'statute', false) THEN statute <> {_ERA} ELSE NOT good_law END, false) THEN score * 0.05 ELSE score END AS lawful FROM judged)"""


def _ablation_sql() -> str:
    """CTEs up to ``scored``: the whole grid per item."""
    sp = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    base = f"""{EDGES}, {_SRCH},
c1 AS (SELECT *, regexp_extract_all("full", '[^{sp}]+') AS ws FROM srch),
fx AS (SELECT doc_id, source, statute, jid, "full" FROM c1 WHERE len(ws) <= 512 UNION ALL
  SELECT doc_id || '::w' || k, source, statute, jid, array_to_string(ws[k * 512 + 1:k * 512 + 512], ' ') FROM (SELECT *, unnest(range((len(ws) - 1) // 512 + 1)) AS k FROM c1 WHERE len(ws) > 512))"""
    out = f"WITH {ITEMS}, {base}"
    union = []
    for tag, src in (("s", "srch"), ("f", "fx")):
        ctes = f"corp AS (SELECT doc_id, source, statute, jid, \"full\" FROM {src}), " + sql_bm25("corp", 50) + ", " + sql_dense("corp")
        ctes = ctes.replace("row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank", "sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank").replace("UNION ALL SELECT * FROM dense", "UNION ALL SELECT query_id, doc_id, rank FROM dense")
        for name in "corp toks size post dfs idfs qt sc hits few pads pool dv0 dv qv0 qv sims allsims dense fused".split():
            ctes = re.sub(rf"(?<![\w.'])\b{name}\b(?=( AS (MATERIALIZED )?\()|[ ,.;)\n]|$)", f"{name}_{tag}", ctes)
        out += ", " + ctes
        chunk = {"s": "structure_aware", "f": "fixed_512"}[tag]
        for r, x in (("bm25", f"SELECT query_id, doc_id, score, rank FROM pool_{tag}"), ("dense", f"SELECT query_id, doc_id, sim AS score, rank FROM dense_{tag}"), ("hybrid", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused_{tag}")):
            union.append(f"SELECT '{chunk}' AS chunking, '{r}' AS retriever, x.*, source, statute, jid FROM ({x}) x JOIN corp_{tag} USING (doc_id)")
    return (
        out
        + ", grid0 AS MATERIALIZED (SELECT g.*, items.query_date, items.applicable_era FROM ("
        + " UNION ALL ".join(union)
        + f""") g JOIN items USING (query_id)),
{_lawful_sql("grid0")},
grid1 AS (SELECT *, unnest(['on', 'off']) AS validity FROM lw),
grid2 AS (SELECT *, round(CASE WHEN validity = 'on' THEN lawful ELSE score END, 9) AS s2 FROM grid1),
grid3 AS (SELECT *, row_number() OVER (PARTITION BY chunking, retriever, validity, query_id ORDER BY s2 DESC, CASE WHEN validity = 'on' THEN first END, rank) AS r2, split_part(doc_id, '|', 2) AS doc FROM grid2),
rel AS (SELECT g.*, coalesce(g.applicable_era, '') AS era, list_contains(b.gold_evidence_ids, doc) OR (chunking = 'fixed_512' AND list_contains(b.gold_evidence_ids, split_part(doc, '::w', 1))) AS rel
  FROM grid3 g JOIN bench_items b ON g.query_id = b.item_id WHERE r2 <= 10 AND b.is_answerable AND len(b.gold_evidence_ids) > 0),
scored AS MATERIALIZED (SELECT chunking, retriever, validity, query_id, max((rel AND r2 <= 5)::INT) AS hit5, max((rel AND r2 <= 10)::INT) AS hit10, coalesce(1.0 / min(CASE WHEN rel THEN r2 END), 0) AS rr,
  coalesce(sum(CASE WHEN rel THEN 1 / log2(r2 + 1) END), 0) AS dcg, max(CASE WHEN r2 = 1 AND era <> '' THEN (statute = era)::INT END) AS era_ok FROM rel GROUP BY ALL)"""
    )


_GRID = _ablation_sql()
_ANS = """ans AS (SELECT item_id AS answer_id, CASE WHEN NOT is_answerable THEN 'The documents do not contain an answer.' ELSE coalesce(gold_answer, '') || ' [Doc 1] ' || CASE WHEN applicable_era = 'IPC' THEN 'It has been repealed. [Doc 2] ' ELSE '' END || question || ' [Doc 9]' END AS answer,
  applicable_era AS gold_statute, split_part(coalesce(gold_evidence_ids[1], '-'), '-', 2) AS gold_section FROM bench_items)"""
_CL = "[" + ", ".join(f"'{w}'" for w in CLAIM_STOPWORDS) + "]"
_CTOK = f"list_distinct([x FOR x IN regexp_extract_all(lower({{}}), '[a-z0-9]+') IF NOT list_contains({_CL}, x)])"
_SUPPORT = (
    _TOP
    + f""", {_ANS},
sh AS (SELECT t.query_id AS answer_id, rank AS n, t.statute, t.section_no, c.text FROM top t JOIN corpus c ON c.ord = t.doc_id WHERE rank <= 5),
sn AS (SELECT answer_id, string_split_regex(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM ans),
s1 AS (SELECT answer_id, [{{'c': trim(regexp_replace(x, '\\[Doc\\s+\\d+\\]', '', 'g')), 'n': list_transform(regexp_extract_all(x, '\\[Doc\\s+(\\d+)\\]', 1), lambda y: y::INT)}} FOR x IN ss] AS cs FROM sn),
s2 AS (SELECT answer_id, [x FOR x IN cs IF x.c <> ''] AS cs FROM s1),
cl AS (SELECT answer_id, unnest(range(len(cs)))::INTEGER AS claim_no, unnest(cs) AS c FROM s2),
ct AS (SELECT answer_id, claim_no, c.c AS claim, len(c.n) AS k, unnest(CASE WHEN len(c.n) = 0 THEN [NULL] ELSE c.n END) AS n, unnest(CASE WHEN len(c.n) = 0 THEN [0] ELSE range(len(c.n)) END) AS pos FROM cl),
cs AS (SELECT answer_id, claim_no, claim, any_value(k)::INTEGER AS n_cited, string_agg(coalesce(sh.text, ''), ' ' ORDER BY pos) AS source FROM ct LEFT JOIN sh USING (answer_id, n) GROUP BY ALL),
sup AS (SELECT answer_id, claim_no, n_cited, CASE WHEN n_cited > 0 THEN len({_CTOK.format("claim")}) = 0 OR len(list_intersect({_CTOK.format("claim")}, {_CTOK.format("source")})) >= 0.5 * len({_CTOK.format("claim")}) END AS supported FROM cs)"""
)
_ERASC = (
    _TOP
    + """, b AS (SELECT item_id AS query_id, applicable_era FROM bench_items WHERE applicable_era <> ''),
es AS (SELECT 'naive' AS mode, (statute = applicable_era)::INT AS ok FROM pool JOIN corp USING (doc_id) JOIN b USING (query_id) WHERE rank = 1 UNION ALL SELECT 'validity', (statute = applicable_era)::INT FROM top JOIN b USING (query_id) WHERE rank = 1)"""
)

_BASE = "split_part(upper(replace({}, ' ', '')), '(', 1)"
_EXACT = (
    _TOP
    + f""", b AS (SELECT item_id AS query_id, split_part(gold_evidence_ids[1], '-', 1) AS gs, {_BASE.format("split_part(gold_evidence_ids[1], '-', 2)")} AS gn FROM bench_items WHERE is_answerable AND applicable_era <> ''),
g AS (SELECT * FROM b WHERE gs IN ('IPC', 'BNS')),
fr AS (SELECT 'naive' AS mode, query_id, statute, section_no FROM pool JOIN corp USING (doc_id) WHERE rank = 1 UNION ALL SELECT 'validity', query_id, statute, section_no FROM top WHERE rank = 1),
es AS (SELECT g.query_id, m.mode, coalesce(fr.statute = gs AND {_BASE.format("fr.section_no")} = gn, false)::INT AS ok FROM g CROSS JOIN (VALUES ('naive'), ('validity')) m(mode) LEFT JOIN fr ON fr.query_id = g.query_id AND fr.mode = m.mode)"""
)

SQL = {
    "bench_slices": f"""WITH {QA}, it AS (SELECT 'item_' || id AS item_id, 'transition' AS slice, query AS question, query_date, gold_statute || ' Section ' || gold_section_no AS gold_answer, gold_statute || '-' || gold_section_no AS gold, gold_statute AS applicable_era FROM qa
  UNION ALL SELECT 'item_' || id || '_stat', 'statutory', query, query_date, gold_statute || ' Section ' || gold_section_no, gold_statute || '-' || gold_section_no, gold_statute FROM qa WHERE ends_with(id, '_post'))
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY md5(item_id || ':13'), item_id) AS r FROM it) WHERE r <= 100""",
    "precedent_items": f"""WITH {EDGES}, {_HOLD}, a AS (SELECT upper(trim(judgment_id)) AS jid, case_name, CAST(date + 1 AS DATE) AS query_date, chunk_id FROM cleanj JOIN fh ON fh.jid = upper(trim(judgment_id))), {sql_good_law('a', 'jid', 'query_date')}
SELECT 'item_prec_' || jid AS item_id, 'What did the court hold in ' || case_name || '?' AS question, query_date, chunk_id AS gold, good_law, reason FROM judged ORDER BY 1 LIMIT 100""",
    "multihop_items": f"""WITH {EDGES}, {_HOLD}, {TRUSTED}, a0 AS (SELECT upper(trim(judgment_id)) AS jid, case_name, list_filter(sections_cited, lambda x: x.statute = 'IPC')[1].section_no AS section, greatest(CAST(date + 730 AS DATE), DATE '2024-07-01') AS query_date FROM cleanj),
a AS (SELECT a0.*, bns_section, chunk_id FROM a0 JOIN trusted t ON t.ipc_section = upper(replace(section, ' ', '')) JOIN fh USING (jid)), {sql_good_law('a', 'jid', 'query_date')}
SELECT 'item_multihop_' || jid AS item_id, 'What section currently governs the offence discussed in ' || case_name || ', and is that case''s holding still good law?' AS question, query_date,
'BNS Section ' || bns_section || ' (successor to IPC Section ' || section || '); the holding in ' || case_name || ' is ' || CASE WHEN good_law THEN 'still good law' ELSE 'no longer good law (' || reason || ')' END || '.' AS gold_answer,
'BNS-' || bns_section || ';' || chunk_id AS gold, good_law FROM judged ORDER BY 1 LIMIT 50""",
    "trap_items": "SELECT item_id, 'trap' AS slice, question, DATE '2025-01-01' AS query_date, false AS is_answerable, 0 AS n_gold FROM (VALUES "
    + ", ".join([f"('item_trap_sec_{s}_{n}', 'What is the punishment prescribed under Section {n} of the {s}?')" for s, n in TRAP_SECTIONS] + [f"('item_trap_case_{len(TRAP_SECTIONS) + i}', 'What did the court hold in {c}?')" for i, c in enumerate(TRAP_CASES)])
    + ") t(item_id, question)",
    "item_problems": """WITH b AS (SELECT * FROM bench_items UNION ALL SELECT * FROM bench_items WHERE ends_with(item_id, '7'))
SELECT item_id, 'unknown slice' AS problem FROM b WHERE slice NOT IN ('statutory', 'transition', 'precedent', 'trap', 'multihop')
UNION ALL SELECT item_id, 'trap item with evidence' FROM b WHERE slice = 'trap' AND len(gold_evidence_ids) > 0
UNION ALL SELECT item_id, 'no gold evidence' FROM b WHERE slice <> 'trap' AND coalesce(len(gold_evidence_ids), 0) = 0
UNION ALL SELECT item_id, 'duplicate item_id' FROM b GROUP BY item_id HAVING count(*) > 1""",
    "slice_counts": "SELECT d.slice, count(item_id) AS n, count(*) FILTER (WHERE is_answerable) AS n_answerable FROM (SELECT unnest(['statutory', 'transition', 'precedent', 'trap', 'multihop', 'unknown']) AS slice) d LEFT JOIN bench_items b ON b.slice = d.slice GROUP BY d.slice",
    "ir_metrics": f"WITH {EDGES}, {ITEMS}, {_SRCH}, "
    + sql_bm25("srch", 50)
    + f""", seen AS (SELECT query_id, doc_id, score, rank AS prior, source, statute, jid, query_date FROM pool JOIN srch USING (doc_id) JOIN items USING (query_id)), {_lawful_sql("seen")},
top AS (SELECT *, split_part(doc_id, '|', 2) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(lawful, 6) DESC, first, prior) AS rank FROM lw) WHERE rank <= 10),
g AS (SELECT item_id AS query_id, gold_evidence_ids AS gold FROM bench_items WHERE is_answerable AND len(gold_evidence_ids) > 0),
r AS (SELECT g.query_id, count(DISTINCT t.doc) AS hits, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM g JOIN top t USING (query_id) WHERE list_contains(gold, t.doc) GROUP BY ALL)
SELECT query_id, round(coalesce(hits, 0) / len(gold), 6) AS recall, round(coalesce(1.0 / first, 0.0), 6) AS mrr, round(coalesce(dcg, 0.0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(len(gold), 10) + 1)]), 6) AS ndcg FROM g LEFT JOIN r USING (query_id)""",
    "ablation_grid": _GRID
    + """, lg AS (SELECT chunking, retriever, validity, unnest(['hit5', 'hit10', 'rr', 'dcg', 'era_ok']) AS metric, unnest([hit5::DOUBLE, hit10::DOUBLE, rr::DOUBLE, dcg::DOUBLE, era_ok::DOUBLE]) AS x FROM scored)
SELECT chunking, retriever, validity, metric, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, count(x) AS n, count(*) - count(x) AS n_excluded FROM lg GROUP BY ALL""",
    "ablation_ci": _GRID + ", sc0 AS (SELECT chunking, retriever, validity, query_id AS o, hit10 AS v FROM scored), " + _BOOT.format(by="chunking, retriever, validity") + ", " + _CI.format(by="chunking, retriever, validity"),
    "ablation_significance": _GRID
    + ", sc0 AS (SELECT chunking, retriever, query_id AS o, max(CASE WHEN validity = 'on' THEN hit10 END) - max(CASE WHEN validity = 'off' THEN hit10 END) AS v FROM scored GROUP BY ALL), "
    + _BOOT.format(by="chunking, retriever")
    + """, pv AS (SELECT chunking || '/' || retriever AS test, round(avg((abs(mean - obs) >= abs(obs) - 1e-12)::INT), 6) AS p FROM rp GROUP BY ALL),
hl AS (SELECT *, 0.05 / (count(*) OVER () - (row_number() OVER (ORDER BY p, test) - 1)) AS th FROM pv)
SELECT test, p, round(th, 6) AS threshold, bool_and(p <= th) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS significant FROM hl""",
    "era_accuracy": _ERASC + " SELECT mode, round(avg(ok), 6) AS accuracy, count(*) AS n FROM es GROUP BY mode",
    "exact_accuracy": _EXACT + " SELECT * FROM es",
    "baseline_vs_validity": _EXACT + " SELECT round(avg(ok) FILTER (WHERE mode = 'naive'), 6) AS naive, round(avg(ok) FILTER (WHERE mode = 'validity'), 6) AS validity, round(avg(ok) FILTER (WHERE mode = 'validity') - avg(ok) FILTER (WHERE mode = 'naive'), 6) AS delta, count(*) FILTER (WHERE mode = 'naive') AS n FROM es",
    "bootstrap_ci": "WITH sc0 AS (SELECT rater, doc_id AS o, max(flagged) AS v FROM review_labels WHERE flagged IS NOT NULL GROUP BY ALL), " + _BOOT.format(by="rater") + ", " + _CI.format(by="rater"),
    "paired_bootstrap": "WITH sc0 AS (SELECT 'all' AS \"set\", doc_id AS o, max(flagged) - min(flagged) AS v FROM review_labels WHERE flagged IS NOT NULL GROUP BY doc_id), "
    + _BOOT.format(by='"set"')
    + ' SELECT "set", round(max(obs), 6) AS diff, round(avg((abs(mean - obs) >= abs(obs) - 1e-12)::INT), 6) AS p FROM rp GROUP BY "set"',
    "holm": "WITH pv AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', {p}::DOUBLE)" for a, p in P_VALUES)
    + """) t(test, p)), hl AS (SELECT *, 0.05 / (count(*) OVER () - (row_number() OVER (ORDER BY p, test) - 1)) AS th FROM pv)
SELECT test, p, round(th, 6) AS threshold, bool_and(p <= th) OVER (ORDER BY p, test ROWS UNBOUNDED PRECEDING) AS significant FROM hl""",
    "claim_support": _SUPPORT + " SELECT * FROM sup",
    "claim_faithfulness": _SUPPORT
    + " SELECT answer_id, count(*) AS n_claims, count(*) FILTER (WHERE n_cited > 0) AS n_cited, round(count(*) FILTER (WHERE supported) / nullif(count(*) FILTER (WHERE n_cited > 0), 0), 6) AS precision, round(count(*) FILTER (WHERE supported) / count(*), 6) AS recall FROM sup GROUP BY answer_id",
    "trap_false_answers": f"WITH {_ANS} SELECT slice, round(avg((NOT contains(lower(answer), 'do not contain an answer'))::INT), 6) AS rate, count(*) AS n FROM ans JOIN bench_items b ON b.item_id = ans.answer_id WHERE NOT is_answerable GROUP BY slice",
}


def _rates_sql() -> tuple[str, str, str]:
    from eralex.plans.validity import SQL as V

    notices = V["validity_notices"]
    head, body = notices.rsplit("SELECT query_id, string_agg", 1)
    full = head.rstrip() + f", nt AS (SELECT query_id, string_agg{body}), {_ANS},\nsh AS (SELECT r.query_id AS answer_id, r.rank AS n, r.statute, r.section_no, c.text FROM r JOIN corpus c ON c.ord = r.doc_id WHERE r.rank <= 5)"
    base = "split_part(upper(replace({}, ' ', '')), '(', 1)"
    rates = f"""{full}, ci AS (SELECT a.*, nt.notices AS notice, list_distinct(list_transform(regexp_extract_all(answer, '\\[Doc (\\d+)\\]', 1), lambda y: y::INT)) AS cited FROM ans a LEFT JOIN nt ON nt.query_id = a.answer_id),
ok AS (SELECT DISTINCT answer_id FROM (SELECT *, unnest(cited) AS n FROM ci) x JOIN sh USING (answer_id, n) WHERE sh.statute = gold_statute AND {base.format("sh.section_no")} = {base.format("gold_section")}),
fl AS (SELECT ci.*, ok.answer_id IS NOT NULL AS good, coalesce(notice <> '', false) AS expct, contains(lower(answer), 'repeal') OR contains(lower(answer), 'not yet in force') OR contains(lower(answer), 'not in force') AS surf FROM ci LEFT JOIN ok USING (answer_id))
SELECT count(*) AS n, round(avg(good::INT), 6) AS citation_accuracy, round(avg((len(cited) = 0)::INT), 6) AS no_citation, round(avg(contains(lower(answer), 'do not contain an answer')::INT), 6) AS abstained, round(count(*) FILTER (WHERE expct AND surf) / nullif(count(*) FILTER (WHERE expct), 0), 6) AS notice_surfaced FROM fl"""
    prompt = f"""{full}, pr AS (SELECT answer_id AS query_id, string_agg('[Doc ' || n || '] ' || statute || ' Section ' || section_no || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS docs FROM sh GROUP BY ALL),
pq AS (SELECT pr.query_id, 'Documents:' || chr(10) || chr(10) || docs || CASE WHEN notices IS NOT NULL THEN chr(10) || chr(10) || 'SYSTEM-VERIFIED VALIDITY NOTICES:' || chr(10) || notices ELSE '' END || chr(10) || chr(10) || 'Question: ' || question AS p FROM pr LEFT JOIN nt USING (query_id) JOIN items USING (query_id))
SELECT query_id, length(p)::INTEGER AS n_chars, md5(p) AS prompt_md5 FROM pq"""
    sampled = rates.replace("FROM ans a LEFT JOIN nt", f"FROM (SELECT * FROM ans ORDER BY md5(answer_id || ':42'), answer_id LIMIT {SAMPLE}) a LEFT JOIN nt")
    return rates, prompt, sampled


SQL["citation_rates"], SQL["prompts"], SQL["sampled_rates"] = _rates_sql()
