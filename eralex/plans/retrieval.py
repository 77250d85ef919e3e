"""Queries of dated retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.functions import text as X
from eralex.config import Settings
from eralex.functions import embedding as E
from eralex.operators import fusion, sparse, validity
from eralex.runtime import table


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "corpus").withColumn("full", F.trim(F.concat_ws(" ", F.nullif("marginal_note", F.lit("")), "text")))


def _items(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "bench_items").withColumnRenamed("item_id", "query_id")


def tokenize_counts(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", X.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


def bm25_term_stats(s: SparkSession, d: str) -> DataFrame:
    c = _corpus(s, d)
    n, _ = sparse.corpus_size(c, "full")
    return sparse.term_stats(sparse.postings(c, "ord", "full"), n).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(s: SparkSession, d: str, size: int | None = None) -> DataFrame:
    return sparse.bm25(_corpus(s, d), "ord", "full", _items(s, d), "query_id", "question", size or Settings.read(s).pool)


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d, 10).withColumnRenamed("doc_id", "ord")


def _dated(s: SparkSession, d: str) -> DataFrame:
    """The pool with the provision's statute and the query's date."""
    docs = table(s, d, "corpus").select(F.col("ord").alias("doc_id"), "statute", "section_no")
    return _bm25(s, d).join(docs, "doc_id").join(_items(s, d).select("query_id", "query_date", "applicable_era"), "query_id")


def naive_topk(s: SparkSession, d: str) -> DataFrame:
    return _dated(s, d).where("rank <= 10").select("query_id", F.col("doc_id").alias("ord"), "statute", "score", "rank")


def validity_topk(s: SparkSession, d: str) -> DataFrame:
    own = Settings.read(s)
    wrong = F.col("statute") != validity.statute_on("query_date", own.cut_over)
    shown = _dated(s, d).withColumn("score", F.round(validity.demoted(F.col("score"), wrong, own.demotion), 6)).withColumnRenamed("rank", "prior")
    return validity.rerank(shown, "score", "prior").where("rank <= 10").select("query_id", F.col("doc_id").alias("ord"), "statute", "score", "rank")


def hash_embedding(s: SparkSession, d: str) -> DataFrame:
    v = E.vectors(_corpus(s, d), ["ord"], "full", Settings.read(s).embedding_dim)
    return v.select("ord", F.posexplode("vec").alias("idx", "value")).where("value <> 0").select("ord", "idx", F.round("value", 6).alias("value"))


def dense_topk(s: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all others."""
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    return E.search(e, "vec_id", "embedding", q, "query_id", "qv", 10)


def _dense(s: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    own = Settings.read(s)
    q = E.vectors(_items(s, d), ["query_id"], "question", own.embedding_dim).withColumnRenamed("vec", "qv")
    v = E.vectors(docs, ["doc_id"], "full", own.embedding_dim)
    return E.search(v, "doc_id", "vec", q, "query_id", "qv", own.pool)


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    docs = _corpus(s, d).select(F.col("ord").alias("doc_id"), "full")
    fused = fusion.rrf(_bm25(s, d), _dense(s, d, docs), k=Settings.read(s).rrf_k)
    return validity.rerank(fused, "score", "doc_id").where("rank <= 10").withColumnRenamed("doc_id", "ord")


RETRIEVERS = ("bm25", "dense", "hybrid")


def retrieve(s: SparkSession, d: str, retriever: str = "hybrid", dated: bool = True, top: int = 10) -> DataFrame:
    """Statutes and judgment chunks by one of ``RETRIEVERS``; dated: wrong-era statutes and bad-law judgments are demoted."""
    from eralex.plans.ingest import clean_judgments

    if retriever not in RETRIEVERS:
        raise ValueError(f"no retriever {retriever!r}; there are {', '.join(RETRIEVERS)}")
    own = Settings.read(s)
    raw = table(s, d, "dense_docs")
    docs = raw.select(F.col("ord").alias("doc_id"), "source", "statute", validity.key_of("judgment_id").alias("jid"), F.coalesce("text", F.lit("")).alias("full"))
    items = _items(s, d)
    lexical = lambda: sparse.bm25(docs, "doc_id", "full", items, "query_id", "question", own.pool)
    if retriever == "bm25":
        pool = lexical().select("query_id", "doc_id", "score")
    elif retriever == "dense":
        pool = _dense(s, d, docs).select("query_id", "doc_id", F.col("sim").alias("score"))
    else:
        pool = fusion.rrf(lexical(), _dense(s, d, docs), k=own.rrf_k)
    seen = pool.join(docs.drop("full"), "doc_id").join(items.select("query_id", "query_date"), "query_id")
    edges = validity.citation_edges(table(s, d, "citations"), clean_judgments(s, d))
    judged = validity.good_law(seen, edges, "jid", "query_date")
    first = F.when(F.col("source") == "statute", 0).otherwise(1) if dated else F.lit(0)
    wrong = F.when(F.col("source") == "statute", F.col("statute") != validity.statute_on("query_date", own.cut_over)).otherwise(~F.col("good_law"))
    score = validity.demoted(F.col("score"), wrong, own.demotion) if dated else F.col("score")
    shown = judged.withColumn("score", F.round(score, 9)).withColumn("first", first)
    return validity.rerank(shown, "score", "first", "doc_id").where(F.col("rank") <= top).select("query_id", F.col("doc_id").alias("ord"), "source", "good_law", "score", "rank")


def hybrid_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieve(s, d)


def lexical_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieve(s, d, "bm25")


def semantic_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieve(s, d, "dense")


def undated_topk(s: SparkSession, d: str) -> DataFrame:
    return retrieve(s, d, "hybrid", dated=False)


def rerank_pool(s: SparkSession, d: str) -> DataFrame:
    """The head of the pool by the share of question words that the provision holds."""
    pool = _bm25(s, d).where("rank <= 30").join(_corpus(s, d).select(F.col("ord").alias("doc_id"), "full"), "doc_id").join(_items(s, d).select("query_id", "question"), "query_id")
    q = F.array_distinct(X.tokens("question"))
    own = F.round(F.size(F.array_intersect(q, X.tokens("full"))) / F.greatest(F.size(q), F.lit(1)), 6)
    return fusion.rerank_head(pool.withColumn("overlap", own), "overlap", Settings.read(s).rerank_head).where("new_rank <= 10").select("query_id", F.col("doc_id").alias("ord"), "rank", "overlap", "new_rank")


QUERIES = {f.__name__: f for f in (tokenize_counts, bm25_term_stats, bm25_topk, naive_topk, validity_topk, hash_embedding, dense_topk, rrf_fusion, hybrid_topk, lexical_topk, semantic_topk, undated_topk, rerank_pool)}

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def sql_tokens(c: str, stop: str = _STOP) -> str:
    return f"[x FOR x IN regexp_extract_all(lower({c}), '[a-z0-9]+') IF NOT list_contains({stop}, x)]"


CORPUS = "corp AS (SELECT ord AS doc_id, statute, section_no, trim(concat_ws(' ', nullif(marginal_note, ''), text)) AS \"full\" FROM corpus)"
ITEMS = "items AS (SELECT item_id AS query_id, question, query_date, applicable_era FROM bench_items)"


def sql_bm25(docs: str, size: int) -> str:
    """CTEs up to ``pool`` over ``docs`` (doc_id, full) and ``items``."""
    return f"""toks AS MATERIALIZED (SELECT doc_id, {sql_tokens('coalesce("full", chr(0))')} AS t FROM {docs}),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
post AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, size GROUP BY term),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens("question")}) AS term FROM items) GROUP BY ALL),
sc AS MATERIALIZED (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idfs USING (term) JOIN post USING (term), size GROUP BY ALL),
hits AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= {size}),
few AS (SELECT i.query_id FROM items i LEFT JOIN hits h USING (query_id) GROUP BY i.query_id HAVING count(h.doc_id) < {size}),
pads AS (SELECT query_id, doc_id, 0.0 AS score FROM few, (SELECT doc_id FROM {docs} ORDER BY doc_id LIMIT {size}) WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM hits)),
pool AS MATERIALIZED (SELECT query_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, score FROM hits UNION ALL SELECT query_id, doc_id, score::DOUBLE FROM pads)) WHERE rank <= {size})"""


def sql_dense(docs: str, size: int = 50) -> str:
    """CTEs up to ``dense`` by signed hashing over ``docs`` and ``items``."""
    place = """(16 * (instr('0123456789abcdef', substr(h, 63, 1)) - 1) + instr('0123456789abcdef', substr(h, 64, 1)) - 1)::INTEGER AS idx,
  CASE WHEN (instr('0123456789abcdef', substr(h, 62, 1)) - 1) % 2 = 0 THEN 1 ELSE -1 END AS sign"""
    out = ""
    for name, src, key, txt in (("dv", docs, "doc_id", '"full"'), ("qv", "items", "query_id", "question")):
        out += f"""{name}0 AS (SELECT {key}, idx, sum(sign)::DOUBLE AS v FROM (SELECT {key}, {place} FROM (SELECT {key}, sha256(unnest(regexp_extract_all(lower({txt}), '[a-z0-9]+'))) AS h FROM {src})) GROUP BY ALL HAVING sum(sign) <> 0),
{name} AS MATERIALIZED (SELECT {key}, idx, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}0),
"""
    return out + f"""sims AS (SELECT q.query_id, doc_id, round(sum(q.v * dv.v), 6) + 0.0 AS sim FROM qv q JOIN dv USING (idx) GROUP BY ALL),
allsims AS (SELECT i.query_id, d.doc_id, coalesce(sim, 0.0) AS sim FROM items i CROSS JOIN {docs} d LEFT JOIN sims USING (query_id, doc_id)),
dense AS MATERIALIZED (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank FROM allsims) WHERE rank <= {size}),
fused AS MATERIALIZED (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM pool UNION ALL SELECT * FROM dense) GROUP BY ALL)"""


_ERA = "CASE WHEN query_date < DATE '2024-07-01' THEN 'IPC' ELSE 'BNS' END"
_HEAD = f"WITH {CORPUS}, {ITEMS}, "

SQL = {
    "tokenize_counts": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, len(list_distinct(t))::INTEGER AS n_terms FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents)",
    "bm25_term_stats": _HEAD + sql_bm25("corp", 10) + " SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "bm25_topk": _HEAD + sql_bm25("corp", 10) + " SELECT query_id, doc_id AS ord, score, rank FROM pool",
    "naive_topk": _HEAD + sql_bm25("corp", 50) + " SELECT query_id, doc_id AS ord, statute, score, rank FROM pool JOIN corp USING (doc_id) WHERE rank <= 10",
    "validity_topk": _HEAD
    + sql_bm25("corp", 50)
    + f""", d AS (SELECT query_id, doc_id, statute, rank AS prior, round(CASE WHEN statute <> {_ERA} THEN score * 0.05 ELSE score END, 6) AS score FROM pool JOIN corp USING (doc_id) JOIN items USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior)::INTEGER AS rank FROM d)
SELECT query_id, doc_id AS ord, statute, score, rank FROM r WHERE rank <= 10""",
    "hash_embedding": _HEAD + sql_bm25("corp", 10) + ", " + sql_dense("corp") + " SELECT doc_id AS ord, idx, round(v, 6) AS value FROM dv",
    "dense_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 6) AS sim FROM v q, v d WHERE q.vec_id % 100 = 0)
SELECT * FROM (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10""",
    "rrf_fusion": _HEAD + sql_bm25("corp", 50) + ", " + sql_dense("corp") + " SELECT * FROM (SELECT query_id, doc_id AS ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fused) WHERE rank <= 10",
    "rerank_pool": _HEAD
    + sql_bm25("corp", 50)
    + f""", o AS (SELECT query_id, doc_id, rank, round(len(list_intersect(list_distinct({sql_tokens("question")}), {sql_tokens('"full"')})) / greatest(len(list_distinct({sql_tokens("question")})), 1), 6) AS overlap FROM pool JOIN corp USING (doc_id) JOIN items USING (query_id) WHERE rank <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, CASE WHEN rank <= 20 THEN overlap END DESC NULLS LAST, rank)::INTEGER AS new_rank FROM o)
SELECT query_id, doc_id AS ord, rank, overlap, new_rank FROM r WHERE new_rank <= 10""",
}
