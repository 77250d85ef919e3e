"""Queries of mapping votes, review and coverage, and their SQL.

Votes are taken from judgments that cite both codes: every pair of an IPC and a BNS section of
one judgment is a vote of its court; the apex court counts as the official source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralex.functions.text import base_section, normal_section, question_for
from eralex.operators import mapping
from eralex.runtime import table

OFFICIAL = "Apex Court"


def votes(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "judgments").where("sections_cited is not null")
    of = lambda st: F.transform(F.filter("sections_cited", lambda x: x["statute"] == st), lambda x: x["section_no"])
    key = F.concat_ws("#", "judgment_id", F.date_format("ingested_at", "yyyyMMddHHmmss"))
    pairs = j.select(F.col("court").alias("source"), key.alias("j"), F.explode(of("IPC")).alias("ipc_section"), of("BNS").alias("b")).select("*", F.explode("b").alias("bns_section"))
    return pairs.select("ipc_section", "bns_section", "source", F.concat_ws("#", "j", "ipc_section", "bns_section").alias("vote_key"), F.concat(F.lit("section "), "ipc_section").alias("description"))


def section_mapping(s: SparkSession, d: str) -> DataFrame:
    return mapping.trusted(votes(s, d), OFFICIAL)


def weighted_vote_trusted(s: SparkSession, d: str) -> DataFrame:
    return section_mapping(s, d)


def weighted_vote_review(s: SparkSession, d: str) -> DataFrame:
    return mapping.review(votes(s, d), OFFICIAL).withColumn("candidates", F.array_join("candidates", ";"))


def _reviewed(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = mapping.review(votes(s, d), OFFICIAL)
    seq = r.select("ipc_section").withColumn("seq", F.row_number().over(W.orderBy("ipc_section")))  # as many rows as sections
    choice = F.when(F.col("seq") == 40, "q").otherwise(F.element_at(F.array(*[F.lit(x) for x in ("0", "1", "s", "", "99")]), (F.col("seq") % 5 + 1).cast("int")))
    return mapping.apply_review(r, seq.withColumn("choice", choice))


def review_apply(s: SparkSession, d: str) -> DataFrame:
    accepted, rest = _reviewed(s, d)
    return accepted.select("ipc_section", "bns_section", F.lit(True).alias("accepted")).unionByName(rest.select("ipc_section", F.lit(None).cast("string").alias("bns_section"), F.lit(False).alias("accepted")))


def _covered(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "corpus")
    return mapping.coverage(section_mapping(s, d), c.where("statute = 'IPC'"), c.where("statute = 'BNS'"))


def coverage_flags(s: SparkSession, d: str) -> DataFrame:
    return _covered(s, d).select("ipc_section", "bns_section", "ipc_text_available", "bns_text_available")


def coverage_missing(s: SparkSession, d: str) -> DataFrame:
    """Mapped sections without a text, per code."""
    m, c = section_mapping(s, d), table(s, d, "corpus")
    old = m.select(F.lit("IPC").alias("statute"), normal_section("ipc_section").alias("section")).join(c.where("statute = 'IPC'").select(normal_section("section_no").alias("section")), "section", "left_anti")
    new = m.select(F.lit("BNS").alias("statute"), base_section("bns_section").alias("section")).join(c.where("statute = 'BNS'").select(base_section("section_no").alias("section")), "section", "left_anti")
    return old.unionByName(new).distinct()


def qa_pairs(s: SparkSession, d: str) -> DataFrame:
    """Two dated items for each covered mapping; numbers count the skipped ones too."""
    numbered = _covered(s, d).withColumn("i", F.row_number().over(W.orderBy("ipc_section")) - 1)  # as many rows as sections
    ok = numbered.where("ipc_text_available and bns_text_available")
    base = F.concat(F.lit("stat_"), F.lpad(F.col("i").cast("string"), 4, "0"))
    cut = F.lit("2024-07-01").cast("date")
    pre = F.struct(F.concat(base, F.lit("_pre")).alias("id"), F.date_sub(cut, 30).alias("query_date"), F.lit("IPC").alias("gold_statute"), F.col("ipc_section").alias("gold_section_no"))
    post = F.struct(F.concat(base, F.lit("_post")).alias("id"), F.date_add(cut, 365).alias("query_date"), F.lit("BNS").alias("gold_statute"), F.col("bns_section").alias("gold_section_no"))
    return ok.select(question_for("description").alias("query"), F.explode(F.array(pre, post)).alias("x")).select("x.id", "query", "x.query_date", "x.gold_statute", "x.gold_section_no")


QUERIES = {f.__name__: f for f in (weighted_vote_trusted, weighted_vote_review, review_apply, coverage_flags, coverage_missing, qa_pairs)}

_N = "upper(replace({}, ' ', ''))"
_B = "split_part(upper(replace({}, ' ', '')), '(', 1)"
TRUSTED = f"""ex AS (SELECT court AS source, judgment_id || '#' || strftime(ingested_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S') AS j, unnest(sections_cited) AS a, sections_cited AS bs FROM judgments),
vo AS (SELECT source, a.section_no AS ipc0, b.section_no AS bns_section, j || '#' || a.section_no || '#' || b.section_no AS vk FROM (SELECT *, unnest(bs) AS b FROM ex WHERE a.statute = 'IPC') WHERE b.statute = 'BNS'),
per AS (SELECT {_N.format("ipc0")} AS ipc_section, bns_section, sum(CASE WHEN source = 'Apex Court' THEN 2 ELSE 1 END)::BIGINT AS votes, list_sort(list(DISTINCT source)) AS srcs, 'section ' || arg_min(ipc0, vk) AS description FROM vo GROUP BY ALL),
tl AS (SELECT *, max(votes) OVER w AS top, sum(votes) OVER w AS total FROM per WINDOW w AS (PARTITION BY ipc_section)),
td AS (SELECT *, sum((votes = top)::INT) OVER (PARTITION BY ipc_section) AS at_top FROM tl),
dec AS (SELECT *, top >= 2 AND at_top = 1 AND top * 2 > total AS decided FROM td),
tal AS (SELECT ipc_section, array_to_string(list_sort(list(bns_section || '=' || votes)), ';') AS tally FROM dec WHERE decided GROUP BY ipc_section),
trusted AS (SELECT ipc_section, bns_section, description, array_to_string(srcs, ';') AS sources, votes, tally FROM dec JOIN tal USING (ipc_section) WHERE decided AND votes = top),
rev AS (SELECT ipc_section, CASE WHEN max(at_top) > 1 THEN 'tied_disagreement' ELSE 'tie_or_single_source' END AS reason, list_sort(list(bns_section)) AS cands FROM dec WHERE NOT decided GROUP BY ipc_section)"""
_COV = f"""cov AS (SELECT t.*, {_B.format("ipc_section")} IN (SELECT {_B.format("section_no")} FROM corpus WHERE statute = 'IPC') AS ipc_text_available,
  {_B.format("bns_section")} IN (SELECT {_B.format("section_no")} FROM corpus WHERE statute = 'BNS') AS bns_text_available FROM trusted t)"""

QA = f"""{TRUSTED}, {_COV}, nm AS (SELECT *, 'stat_' || lpad((row_number() OVER (ORDER BY ipc_section) - 1)::VARCHAR, 4, '0') AS b, 'What is the applicable law for: ' || description || '?' AS query FROM cov),
qa AS (SELECT b || '_pre' AS id, query, DATE '2024-06-01' AS query_date, 'IPC' AS gold_statute, ipc_section AS gold_section_no FROM nm WHERE ipc_text_available AND bns_text_available
UNION ALL SELECT b || '_post', query, DATE '2025-07-01', 'BNS', bns_section FROM nm WHERE ipc_text_available AND bns_text_available)"""

SQL = {
    "weighted_vote_trusted": f"WITH {TRUSTED} SELECT * FROM trusted",
    "weighted_vote_review": f"WITH {TRUSTED} SELECT ipc_section, reason, array_to_string(cands, ';') AS candidates FROM rev",
    "review_apply": f"""WITH {TRUSTED}, sq AS (SELECT *, row_number() OVER (ORDER BY ipc_section) AS seq FROM rev),
ch AS (SELECT *, CASE WHEN seq = 40 THEN 'q' ELSE (['0', '1', 's', '', '99'])[seq % 5 + 1] END AS choice FROM sq),
op AS (SELECT *, CASE WHEN seq < coalesce((SELECT min(seq) FROM ch WHERE choice = 'q'), 1000000) THEN try_cast(choice AS INT) END AS k FROM ch)
SELECT ipc_section, cands[k + 1] AS bns_section, cands[k + 1] IS NOT NULL AS accepted FROM op""",
    "coverage_flags": f"WITH {TRUSTED}, {_COV} SELECT ipc_section, bns_section, ipc_text_available, bns_text_available FROM cov",
    "coverage_missing": f"""WITH {TRUSTED} SELECT DISTINCT 'IPC' AS statute, {_N.format("ipc_section")} AS section FROM trusted WHERE {_N.format("ipc_section")} NOT IN (SELECT {_N.format("section_no")} FROM corpus WHERE statute = 'IPC')
UNION SELECT DISTINCT 'BNS', {_B.format("bns_section")} FROM trusted WHERE {_B.format("bns_section")} NOT IN (SELECT {_B.format("section_no")} FROM corpus WHERE statute = 'BNS')""",
    "qa_pairs": f"WITH {QA} SELECT * FROM qa",
}
