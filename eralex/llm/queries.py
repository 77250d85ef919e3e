"""Queries of the training-data problems over the driver's tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.llm import abuse, chunking, encoding, fusion, leakage, packing, personal, scans, templates
from eralex.runtime import table

# Problem 2


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repair(table(spark, d, "corpus"), "ord", "text").withColumnRenamed("row_id", "ord")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_repaired(spark, d).select("ord")


# Problem 3


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    parties = table(spark, d, "metadata")
    model = personal.train().with_names(personal.name_field(parties, ["petitioner", "respondent"]))
    docs = personal.redact(table(spark, d, "dense_docs"), "ord", ["text"], model).select(F.lit("dense_docs").alias("table_name"), "*")
    return docs.unionByName(personal.redact(parties, "rec_id", ["petitioner", "respondent"], model).select(F.lit("metadata").alias("table_name"), "*")).withColumnRenamed("row_id", "row_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_redacted(spark, d).select("table_name", "row_key", "field_name", F.explode("pii_types").alias("pii_type"))


# Problem 4


def _chunk_limit(spark: SparkSession, d: str) -> tuple[int, int]:
    r = table(spark, d, "size_limits").where("limit_name = 'dense_chunk'").select("capacity", "overlap").head()
    return r[0], r[1]


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "dense_docs"), "text", *_chunk_limit(spark, d), ["ord", "doc_id", "rhetorical_unit"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 0").select("ord")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each text add up to: its words once, none over the limit, every overlap as it must be."""
    limit, overlap = _chunk_limit(spark, d)
    p = p4_pieces(spark, d)
    shared = F.when(F.col("piece_no") == 0, 0).otherwise(overlap)
    return p.groupBy("ord").agg(
        F.sum(F.col("n_words") - F.col("overlap_words")).alias("n_words"), F.max("n_pieces").cast("long").alias("n_pieces_said"), F.count("*").alias("n_pieces"),
        F.count(F.when(F.col("n_words") > limit, 1)).alias("n_over"), F.count(F.when(F.col("overlap_words") != shared, 1)).alias("n_other_overlap"),
    ).select("ord", "n_words", (F.col("n_pieces") == F.col("n_pieces_said")).alias("complete"), "n_over", "n_other_overlap")


# Problem 5


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(table(spark, d, "dense_docs"), "ord", ["text"], ["case_name"]).withColumnRenamed("row_id", "ord")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_repaired(spark, d).select("ord", "field_name")


# Problem 6
LINES = ("ord", "doc_id", "court", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return templates.repeated_lines(table(spark, d, "dense_docs"), *LINES).select(F.col("row_id").alias("ord"), "line_no")


def p6_templates(spark: SparkSession, d: str) -> DataFrame:
    return templates.templates(table(spark, d, "dense_docs"), *LINES).withColumnRenamed("source", "court")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the lines that the exact rule confirms."""
    return templates.without_repeated_lines(table(spark, d, "dense_docs"), *LINES).withColumnRenamed("row_id", "ord")


# Problem 7
TEXTS = "title petitioner respondent description judge author_judge citation case_id cnr decision_date disposal_nature court available_languages path nc_display".split()


def _fused(spark: SparkSession, d: str, single: bool) -> DataFrame:
    plain = {c: F.upper(F.regexp_replace(F.trim(c), r"\s+", " ")) for c in TEXTS}
    plain["title"] = F.regexp_replace(plain["title"], r" (VERSUS|VS\.?|V\.?) ", " V. ")
    plain["year"] = F.col("year")
    plain["cnr"], plain["decision_date"] = fusion.group_key("cnr"), fusion.valid_date("decision_date", "scraped_at")
    return fusion.fuse(table(spark, d, "metadata"), "cnr", "rec_id", "feed", "decision_date", "scraped_at", TEXTS, plain, single=single)


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, True)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d, False).select("group_rec_id", "best_rec_id")


# Problem 8


def _tokenizer(spark: SparkSession) -> str:
    """Path of the vocabulary file: ``eralex.tokenizer`` of the session, else ``ERALEX_TOKENIZER``, else the default."""
    return spark.conf.get("eralex.tokenizer", None) or os.environ.get("ERALEX_TOKENIZER") or packing.TOKENIZER


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r[0]: r[1] for r in table(spark, d, "size_limits").where("limit_name like 'pack%'").select("limit_name", "capacity").collect()}


def p8_assignments(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents"), "doc_id", "text", _tokenizer(spark)), _capacities(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p8_assignments(spark, d), _capacities(spark, d))


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per pack: documents placed, containers over the capacity, and documents within it that were split."""
    caps = _capacities(spark, d)
    a = p8_assignments(spark, d)
    cap = F.create_map(*[F.lit(x) for kv in sorted(caps.items()) for x in kv])[F.col("pack")]
    docs = a.groupBy("pack", "doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).groupBy("pack").agg(F.count("*").alias("n_docs"), F.count(F.when((F.col("n") > 1) & (F.col("tokens") <= cap), 1)).alias("n_split"))
    over = a.groupBy("pack", "container_id").agg(F.sum("n_tokens").alias("tokens")).groupBy("pack").agg(F.count(F.when(F.col("tokens") > cap, 1)).alias("n_over"))
    return docs.join(over, "pack").select("pack", "n_docs", "n_split", "n_over")


# Problem 9


def _passages(spark: SparkSession, d: str) -> list[tuple[str, str, str]]:
    return leakage.passages_of(table(spark, d, "bench_items"), "item_id", ["question", "gold_answer"])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, d, "documents"), "doc_id", "text", _passages(spark, d))


def p9_matches(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", _passages(spark, d))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), "doc_id", "text", _passages(spark, d)).select("doc_id", "source", "n_chars")


# Problem 10


def _scored(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    model = abuse.fit(documents, "doc_id", "text", table(spark, d, "review_labels"), "doc_id", "flagged")
    return abuse.score(documents, model, ["doc_id", "source"], "text")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score > 0.5").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d), "source")


QUERIES = {f.__name__: f for f in (p2_found, p2_repaired, p3_found, p3_redacted, p4_found, p4_pieces, p4_coverage, p5_found, p5_repaired, p6_found, p6_templates, p6_clean, p7_found, p7_survivors, p8_assignments, p8_containers, p8_coverage, p9_found, p9_matches, p9_clean, p10_found, p10_scores, p10_rates)}

_SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LINES = r"""parts AS (SELECT ord, doc_id, court, string_split(text, chr(10)) AS ls FROM dense_docs
  WHERE text IS NOT NULL AND doc_id IS NOT NULL AND trim(court) <> ''),
lines AS (SELECT ord, doc_id, court, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM parts),
keyed AS (SELECT *, replace(regexp_replace(regexp_replace(lower(line), '[^\p{L}0-9]+', ' ', 'g'), '[0-9]+', '#', 'g'), ' ', '') AS k FROM lines),
counted AS (SELECT court, k, count(DISTINCT doc_id) AS n FROM keyed WHERE length(replace(k, '#', '')) >= 12 GROUP BY court, k),
sizes AS (SELECT court, count(DISTINCT doc_id) AS m FROM dense_docs GROUP BY court),
rep AS (SELECT c.court, c.k FROM counted c JOIN sizes s USING (court) WHERE n >= 5 AND n >= 0.03 * m),
hit AS (SELECT ord, line_no FROM keyed JOIN rep USING (court, k))"""
_TREE = r"""parts AS (SELECT ord, doc_id, court, string_split(text, chr(10)) AS ls FROM dense_docs WHERE text IS NOT NULL AND doc_id IS NOT NULL AND trim(court) <> ''),
raw AS (SELECT ord, doc_id, court, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM parts),
sp AS (SELECT ord, line_no, doc_id, court, string_split(trim(regexp_replace(regexp_replace(lower(line), '[^\p{L}0-9]+', ' ', 'g'), '[0-9]+', '#', 'g')), ' ') AS ws FROM raw),
ln AS (SELECT *, len(ws) AS n, ws[1] AS lead FROM sp WHERE length(replace(array_to_string(ws, ''), '#', '')) >= 12),
sizes AS (SELECT court, count(DISTINCT doc_id) AS m, greatest(5.0, 0.03 * count(DISTINCT doc_id)) - 1e-9 AS need FROM dense_docs WHERE doc_id IS NOT NULL AND trim(court) <> '' GROUP BY court),
nodes AS (SELECT court, n, lead, count(*) AS c FROM ln GROUP BY ALL),
own AS (SELECT court, n, lead FROM nodes JOIN sizes USING (court) WHERE c >= need),
leaves AS (SELECT court, n, lead FROM own UNION ALL
  SELECT court, n, '<*>' FROM (SELECT court, n, sum(c) AS c FROM nodes ANTI JOIN own USING (court, n, lead) GROUP BY ALL) JOIN sizes USING (court) WHERE c >= need),
led AS (SELECT l.* EXCLUDE (lead), CASE WHEN o.court IS NULL THEN '<*>' ELSE l.lead END AS lead FROM ln l LEFT JOIN own o ON l.court = o.court AND l.n = o.n AND l.lead = o.lead),
placed AS (SELECT * FROM led SEMI JOIN leaves USING (court, n, lead)),
slots AS (SELECT ord, line_no, doc_id, court, n, lead, unnest(ws) AS w, unnest(range(n)) AS slot FROM placed),
fixed AS (SELECT court, n, lead, slot, w FROM (SELECT court, n, lead, slot, w, count(*) AS c FROM slots GROUP BY ALL) JOIN sizes USING (court) WHERE c >= need AND w <> '#'),
told AS (SELECT s.ord, s.line_no, s.doc_id, s.court, string_agg(coalesce(f.w, '<*>'), ' ' ORDER BY s.slot) AS template, count(f.w) AS k, sum(length(coalesce(f.w, ''))) AS letters, any_value(s.n) AS n
  FROM slots s LEFT JOIN fixed f ON s.court = f.court AND s.n = f.n AND s.lead = f.lead AND s.slot = f.slot AND s.w = f.w GROUP BY ALL)"""
_GRAMS = r"""p AS (SELECT item_id, unnest([question, gold_answer]) AS t FROM bench_items),
pw AS (SELECT item_id, regexp_extract_all(lower(t), '[\p{L}\p{Nd}]+') AS w FROM p WHERE t IS NOT NULL),
pg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM pw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents),
dg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN pg USING (g))"""

SQL = {
    "p4_found": f"SELECT ord FROM dense_docs WHERE len(regexp_extract_all(text, '[^{_SPACES}]+')) > (SELECT capacity FROM size_limits WHERE limit_name = 'dense_chunk')",
    "p4_coverage": f"""WITH w AS (SELECT ord, len(regexp_extract_all(text, '[^{_SPACES}]+')) AS n FROM dense_docs)
SELECT ord, n AS n_words, true AS complete, 0 AS n_over, 0 AS n_other_overlap FROM w WHERE n > (SELECT capacity FROM size_limits WHERE limit_name = 'dense_chunk')""",
    "p8_coverage": "SELECT limit_name AS pack, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS n_docs, 0 AS n_split, 0 AS n_over FROM size_limits WHERE limit_name LIKE 'pack%'",
    "p9_matches": r"""WITH p AS (SELECT item_id, 'question' AS field, question AS t FROM bench_items UNION ALL SELECT item_id, 'gold_answer', gold_answer FROM bench_items),
pw AS (SELECT item_id, field, regexp_extract_all(lower(t), '[\p{L}\p{Nd}]+') AS w FROM p WHERE t IS NOT NULL),
pg AS (SELECT item_id, field, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM pw)),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents),
dg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS i FROM dw)),
hit AS (SELECT doc_id, item_id, field, dg.i AS d, pg.i AS p FROM dg JOIN pg USING (g)),
isl AS (SELECT *, d - row_number() OVER (PARTITION BY doc_id, item_id, field, d - p ORDER BY d) AS k FROM hit)
SELECT doc_id, item_id, field, min(d) - 1 AS doc_word, min(p) - 1 AS item_word, count(*) + 11 AS n_words FROM isl GROUP BY doc_id, item_id, field, d - p, k""",
    "p6_found": f"WITH {_LINES} SELECT ord, line_no FROM hit",
    "p6_clean": f"""WITH {_LINES},
gone AS (SELECT ord, count(*) AS n_removed, list(line_no) AS nos FROM hit GROUP BY ord),
kept AS (SELECT ord, string_agg(line, chr(10) ORDER BY line_no) AS t FROM keyed JOIN gone USING (ord) WHERE NOT list_contains(nos, line_no) GROUP BY ord)
SELECT d.ord, CASE WHEN g.ord IS NULL THEN d.text ELSE coalesce(k.t, '') END AS clean_text, coalesce(n_removed, 0)::INTEGER AS n_removed
FROM dense_docs d LEFT JOIN gone g ON d.ord = g.ord LEFT JOIN kept k ON d.ord = k.ord""",
    "p6_templates": f"""WITH {_TREE}
SELECT court, template, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines, round(count(DISTINCT doc_id) / any_value(m), 6) AS share
FROM told JOIN sizes USING (court) WHERE 2 * k >= n AND letters >= 12 GROUP BY court, template HAVING count(DISTINCT doc_id) >= any_value(need)""",
    "p7_found": f"""WITH r AS (SELECT *, regexp_replace(upper(cnr), '[^A-Z0-9]', '', 'g') AS k,
  coalesce(CAST(try_strptime(substr(decision_date, 1, 10), '%Y-%m-%d') AS DATE), CAST(try_strptime(decision_date, '%d-%m-%Y') AS DATE)) AS dt,
  {" + ".join(f"(coalesce(regexp_matches({c}, '[^ ]'), false))::INT" for c in TEXTS)} AS filled FROM metadata),
v AS (SELECT *, CASE WHEN dt > CAST(scraped_at AT TIME ZONE 'UTC' AS DATE) THEN NULL ELSE dt END AS ok FROM r WHERE k <> ''),
n AS (SELECT *, count(*) OVER (PARTITION BY k) AS c, min(rec_id) OVER (PARTITION BY k) AS group_rec_id,
  row_number() OVER (PARTITION BY k ORDER BY ok DESC NULLS LAST, filled DESC, scraped_at DESC NULLS LAST, rec_id) AS i FROM v)
SELECT group_rec_id, rec_id AS best_rec_id FROM n WHERE c > 1 AND i = 1""",
    "p9_found": f"WITH {_GRAMS} SELECT doc_id, item_id FROM leaks",
    "p9_clean": f"WITH {_GRAMS} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
}
