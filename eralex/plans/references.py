"""Queries of problem 1 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.operators import references as R
from eralex.runtime import table

COLUMNS = ["citing_judgment_id", "cited_judgment_id"]
RECORDS = ("judgment_id", "ingested_at", "withdrawn_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = R.orphan_references(table(spark, d, "citations"), "citation_id", COLUMNS, "extracted_at", table(spark, d, "judgments"), *RECORDS)
    return found.select(F.col("row_id").alias("citation_id"), "ref_column")


def p1_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return R.orphan_report("citations", table(spark, d, "citations"), COLUMNS, "extracted_at", table(spark, d, "judgments"), *RECORDS)


def p1_current_orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = R.references(table(spark, d, "citations"), "citation_id", COLUMNS, "extracted_at")
    return R.current_orphans(R.signed_state(R.existence_deltas(table(spark, d, "judgments"), *RECORDS), refs))


QUERIES = {"p1_found": p1_found, "p1_orphan_report": p1_orphan_report, "p1_current_orphans": p1_current_orphans}

_REFS = """refs AS (
  SELECT citation_id, 'citing_judgment_id' AS ref_column, upper(trim(citing_judgment_id)) AS k, extracted_at AS ts FROM citations
  UNION ALL
  SELECT citation_id, 'cited_judgment_id', upper(trim(cited_judgment_id)), extracted_at FROM citations),
r AS (SELECT * FROM refs WHERE k IS NOT NULL AND k <> ''),
ivals AS (SELECT DISTINCT upper(trim(judgment_id)) AS k, ingested_at AS s, withdrawn_at AS u FROM judgments),
alive AS (SELECT DISTINCT r.citation_id, r.ref_column FROM r JOIN ivals i ON r.k = i.k AND i.s <= r.ts AND (i.u IS NULL OR i.u > r.ts)),
marked AS (SELECT r.*, a.citation_id IS NULL AS lost FROM r LEFT JOIN alive a ON r.citation_id = a.citation_id AND r.ref_column = a.ref_column)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT citation_id, ref_column FROM marked WHERE lost",
    "p1_orphan_report": f"""WITH {_REFS}
SELECT 'citations' AS table_name, ref_column, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_references,
  count(*) FILTER (WHERE lost) AS n_orphans, count(DISTINCT k) FILTER (WHERE lost) AS n_orphan_keys
FROM marked GROUP BY ALL""",
    "p1_current_orphans": f"""WITH {_REFS}
SELECT k AS "key", count(*) AS refs FROM r
WHERE k NOT IN (SELECT k FROM ivals WHERE k IS NOT NULL AND s IS NOT NULL AND u IS NULL) GROUP BY k""",
}
