"""Queries of the citation graph and validity, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.operators import validity
from eralex.operators.references import key_of
from eralex.plans.ingest import VALIDATED, clean_judgments
from eralex.plans.retrieval import _ERA, _HEAD, CORPUS, sql_bm25, sql_dense, validity_topk
from eralex.runtime import table


def _edges(s: SparkSession, d: str) -> DataFrame:
    return validity.citation_edges(table(s, d, "citations"), clean_judgments(s, d))


def overruling_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).where("invalidates").select("target", "citing", "inv_on", "signal", "edge_ord")


def informational_edges(s: SparkSession, d: str) -> DataFrame:
    return _edges(s, d).where("not invalidates").groupBy("target", "signal").agg(F.count("*").alias("n"), F.min("inv_on").alias("first_on"), F.max("inv_on").alias("last_on"))


def good_law_asof(s: SparkSession, d: str) -> DataFrame:
    """Every clean judgment on the day after it, and 730 days after."""
    asked = clean_judgments(s, d).select(key_of("judgment_id").alias("jid"), F.explode(F.array(F.date_add("date", 1), F.date_add("date", 730))).alias("day"))
    return validity.good_law(asked, _edges(s, d), "jid", "day")


def validity_notices(s: SparkSession, d: str) -> DataFrame:
    """The notices of each query's results, in rank order."""
    from eralex.plans.mapping import section_mapping

    docs = table(s, d, "corpus").select("ord", "section_no")
    day = table(s, d, "bench_items").select(F.col("item_id").alias("query_id"), "query_date")
    succ = section_mapping(s, d).select(F.col("ipc_section").alias("k"), F.col("bns_section").alias("successor"))
    j = validity_topk(s, d).where("rank <= 5").join(docs, "ord").join(day, "query_id").join(succ, F.upper(F.replace("section_no", F.lit(" "), F.lit(""))) == F.col("k"), "left")
    n = j.withColumn("notice", validity.notice(F.col("statute"), F.col("section_no"), F.col("query_date"), F.when(F.col("statute") == "IPC", F.col("successor")))).where("notice is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "notice"))), lambda x: x["notice"])
    return n.groupBy("query_id").agg(F.array_join(lines, "\n").alias("notices"), F.count("*").cast("int").alias("n"))


def precedent_rate(s: SparkSession, d: str) -> DataFrame:
    """Per citing court: share of resolved citations that are good law on the citing day."""
    cited = _edges(s, d).select(F.col("target").alias("jid"), F.col("inv_on").alias("day"), "citing")
    court = clean_judgments(s, d).select(key_of("judgment_id").alias("citing"), "court")
    return validity.good_law(cited, _edges(s, d), "jid", "day").join(court, "citing").groupBy("court").agg(F.round(F.avg(F.col("good_law").cast("double")), 6).alias("rate"), F.count("*").alias("n"))


def fabricated_rate(s: SparkSession, d: str) -> DataFrame:
    """Per citing judgment: share of its cited ids that are no known judgment; null without any."""
    c = table(s, d, "citations").select(key_of("citing_judgment_id").alias("citing"), key_of("cited_judgment_id").alias("cited")).where("citing is not null")
    known = table(s, d, "judgments").select(key_of("judgment_id").alias("cited")).distinct().withColumn("known", F.lit(True))
    j = c.join(known, "cited", "left")
    missing = F.when(F.col("cited").isNotNull(), F.col("known").isNull().cast("double"))
    return j.groupBy("citing").agg(F.round(F.avg(missing), 6).alias("rate"), F.count("cited").alias("n"))


QUERIES = {f.__name__: f for f in (overruling_edges, informational_edges, good_law_asof, validity_notices, precedent_rate, fabricated_rate)}

EDGES = f"""{VALIDATED},
cj AS (SELECT upper(trim(judgment_id)) AS jid, date AS inv_on, court FROM cleanj),
edges AS (SELECT upper(trim(c.cited_judgment_id)) AS target, j.jid AS citing, j.inv_on, c.signal, c.citation_id AS edge_ord, c.signal IN ('overruled', 'reversed') AS invalidates
  FROM citations c JOIN cj j ON upper(trim(c.citing_judgment_id)) = j.jid WHERE upper(trim(c.cited_judgment_id)) IN (SELECT jid FROM cj))"""


def sql_good_law(asked: str, jid: str, day: str) -> str:
    """CTE ``judged``: ``asked`` with good_law and reason."""
    return f"""judged AS (SELECT a.*, e.edge_ord IS NULL AS good_law, CASE WHEN e.edge_ord IS NOT NULL THEN e.signal || ' by ' || e.citing || ' on ' || e.inv_on END AS reason
  FROM {asked} a LEFT JOIN (SELECT k.{jid}, k.{day}, min(e.edge_ord) AS o FROM (SELECT DISTINCT {jid}, {day} FROM {asked}) k JOIN edges e ON e.invalidates AND e.target = k.{jid} AND e.inv_on <= k.{day} GROUP BY ALL) h
  ON a.{jid} = h.{jid} AND a.{day} = h.{day} LEFT JOIN edges e ON e.edge_ord = h.o)"""


SQL = {
    "overruling_edges": f"WITH {EDGES} SELECT target, citing, inv_on, signal, edge_ord FROM edges WHERE invalidates",
    "informational_edges": f"WITH {EDGES} SELECT target, signal, count(*) AS n, min(inv_on) AS first_on, max(inv_on) AS last_on FROM edges WHERE NOT invalidates GROUP BY ALL",
    "good_law_asof": f"WITH {EDGES}, asked AS (SELECT upper(trim(judgment_id)) AS jid, unnest([CAST(date + 1 AS DATE), CAST(date + 730 AS DATE)]) AS day FROM cleanj), {sql_good_law('asked', 'jid', 'day')} SELECT * FROM judged",
    "precedent_rate": f"WITH {EDGES}, asked AS (SELECT target AS jid, inv_on AS day, citing FROM edges), {sql_good_law('asked', 'jid', 'day')} SELECT court, round(avg(good_law::INT), 6) AS rate, count(*) AS n FROM judged JOIN cj ON cj.jid = judged.citing GROUP BY court",
    "fabricated_rate": """WITH c AS (SELECT upper(trim(citing_judgment_id)) AS citing, nullif(upper(trim(cited_judgment_id)), '') AS cited FROM citations WHERE trim(citing_judgment_id) <> ''),
k AS (SELECT DISTINCT upper(trim(judgment_id)) AS cited FROM judgments)
SELECT citing, round(avg(CASE WHEN c.cited IS NOT NULL THEN (k.cited IS NULL)::INT END), 6) AS rate, count(c.cited) AS n FROM c LEFT JOIN k ON c.cited = k.cited GROUP BY citing""",
}

_DENSE_HEAD = _HEAD.replace(CORPUS, 'corp AS (SELECT ord AS doc_id, source, statute, nullif(upper(trim(judgment_id)), \'\') AS jid, coalesce(text, \'\') AS "full" FROM dense_docs)')


def _retrieve_sql(pool: str, dated: bool = True) -> str:
    bad = f"coalesce(CASE WHEN source = 'statute' THEN statute <> {_ERA} ELSE NOT good_law END, false)" if dated else "false"
    dense = sql_dense("corp").replace("row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank", "sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id)::INTEGER AS rank").replace("UNION ALL SELECT * FROM dense", "UNION ALL SELECT query_id, doc_id, rank FROM dense")
    return f"""{_DENSE_HEAD}{sql_bm25("corp", 50)}, {dense}, {EDGES},
seen AS (SELECT query_id, doc_id, score, source, statute, jid, query_date FROM ({pool}) x JOIN corp USING (doc_id) JOIN items USING (query_id)), {sql_good_law('seen', 'jid', 'query_date')},
dem AS (SELECT *, round(CASE WHEN {bad} THEN score * 0.05 ELSE score END, 9) AS s2 FROM judged),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, {"CASE WHEN source = 'statute' THEN 0 ELSE 1 END" if dated else "0"}, doc_id)::INTEGER AS rank FROM dem)
SELECT query_id, doc_id AS ord, source, good_law, s2 AS score, rank FROM r WHERE rank <= 10"""


_FUSED = "SELECT query_id, doc_id, score FROM fused"
SQL |= {
    "hybrid_topk": _retrieve_sql(_FUSED),
    "undated_topk": _retrieve_sql(_FUSED, False),
    "lexical_topk": _retrieve_sql("SELECT query_id, doc_id, score FROM pool"),
    "semantic_topk": _retrieve_sql("SELECT query_id, doc_id, sim AS score FROM dense"),
}


def _notice_sql() -> str:
    from eralex.plans.mapping import TRUSTED

    return f"""{_HEAD}{sql_bm25("corp", 50)}, {TRUSTED},
d AS (SELECT query_id, doc_id, statute, section_no, query_date, rank AS prior, round(CASE WHEN statute <> {_ERA} THEN score * 0.05 ELSE score END, 6) AS score FROM pool JOIN corp USING (doc_id) JOIN items USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prior) AS rank FROM d),
n AS (SELECT query_id, rank, CASE WHEN statute <> {_ERA} THEN statute || ' Section ' || section_no || ' was ' || CASE WHEN statute = 'IPC' THEN 'repealed' ELSE 'not yet in force' END || ' as of ' || query_date || ' (BNS commencement date: 2024-07-01).'
  WHEN statute = 'IPC' AND t.bns_section IS NOT NULL THEN 'IPC Section ' || section_no || ' was repealed w.e.f. 2024-07-01; corresponding current provision is BNS Section ' || t.bns_section || '.' END AS notice
  FROM r LEFT JOIN trusted t ON t.ipc_section = upper(replace(section_no, ' ', '')) WHERE rank <= 5)
SELECT query_id, string_agg(notice, chr(10) ORDER BY rank) AS notices, count(*)::INTEGER AS n FROM n WHERE notice IS NOT NULL GROUP BY query_id"""


SQL["validity_notices"] = _notice_sql()
