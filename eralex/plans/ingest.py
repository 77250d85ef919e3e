"""Queries of ingest, fetch filters, samples and running targets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralex.functions import text as X
from eralex.operators import ingest, windows
from eralex.runtime import table

ORDER = ["ingested_at", "case_name", "text"]


def clean_judgments(s: SparkSession, d: str) -> DataFrame:
    return ingest.clean(table(s, d, "judgments"), ORDER)


def ingest_clean(s: SparkSession, d: str) -> DataFrame:
    return clean_judgments(s, d).select("judgment_id", "court", "date", "disposal", "ingested_at", F.size("sections_cited").alias("n_sections"))


def ingest_rejected(s: SparkSession, d: str) -> DataFrame:
    return ingest.rejected(table(s, d, "judgments"), ORDER).select("judgment_id", "ingested_at", F.array_join("problems", "; ").alias("problems"))


def ingest_summary(s: SparkSession, d: str) -> DataFrame:
    return clean_judgments(s, d).groupBy("disposal").agg(F.count("*").alias("n"), F.countDistinct("court").alias("n_courts"), F.min("date").alias("first"), F.max("date").alias("last"))


def latest_per_key(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metadata").withColumn("day", X.normal_date("decision_date"))
    return windows.latest(m.where("cnr is not null"), ["cnr"], F.desc_nulls_last("day"), "rec_id").select("cnr", "rec_id", "day")


def date_texts(s: SparkSession, d: str) -> DataFrame:
    """Dates as ISO text, unreadable ones as they stand."""
    return table(s, d, "metadata").select("rec_id", X.date_text("decision_date").alias("day"))


def boolean_filter(s: SparkSession, d: str) -> DataFrame:
    """Filtered by a flag that the source has, and by one that it lacks."""
    b = table(s, d, "bench_items")
    return ingest.true_if_there(b, "is_answerable").select("item_id", F.lit(True).alias("flagged")).unionByName(ingest.true_if_there(b, "is_final").select("item_id", F.lit(False).alias("flagged")))


def skip_reasons(s: SparkSession, d: str) -> DataFrame:
    """Counts of the first reason for which a record would not be taken."""
    m = table(s, d, "metadata")
    reason = ingest.first_reason(
        ("no file", F.col("path").isNull() | (F.trim("path") == "")),
        ("no text", F.col("description").isNull()),
        ("too short", F.length(F.trim("description")) < 100),
        ("sensitive", X.sensitive("title", "description")),
        ("no sections", ~F.col("description").rlike(r"(?i)section \d")),
    )
    return m.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def filter_if_any(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metadata").select("rec_id", "available_languages")
    return ingest.filter_if_any(m, F.lower("available_languages").contains("english"))


def filter_if_none(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metadata").select("rec_id", "available_languages")
    return ingest.filter_if_any(m, F.lower("available_languages").contains("esperanto"))


def equality_filter(s: SparkSession, d: str) -> DataFrame:
    m = ingest.require(table(s, d, "metadata"), ["rec_id", "court"])
    return ingest.equals_if_there(ingest.equals_if_there(m, "feed", "official"), "judicial_section", "civil").select("rec_id", "court")


def name_fallbacks(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metadata")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    both = F.when(some("petitioner").isNotNull() & some("respondent").isNotNull(), F.concat_ws(" v. ", some("petitioner"), some("respondent")))
    return m.select(
        "rec_id",
        F.coalesce(some("title"), both, F.concat(F.lit("Case "), F.col("rec_id").cast("string"))).alias("case_name"),
        F.coalesce(some("cnr"), some("case_id"), F.concat(F.lit("SC-"), F.col("year").cast("string"), F.lit("-"), F.col("rec_id").cast("string"))).alias("case_key"),
        F.coalesce(some("judge"), some("author_judge")).alias("judge"),
        F.array_join(X.split_list("judge"), "|").alias("bench"),
        X.base_name("path").alias("file_name"),
        X.normal_date("decision_date").alias("day"),
    )


def running_target(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "metadata").where("court is not null").withColumn("one", F.lit(1))
    return windows.until_target(m, "court", "scraped_at", ["rec_id"], "one", 40).select("court", "rec_id", "before")


def top_judges(s: SparkSession, d: str) -> DataFrame:
    """The three busiest judges of each court."""
    j = table(s, d, "judgments").select("court", F.explode("bench").alias("judge")).groupBy("court", "judge").agg(F.count("*").alias("n"))
    w = W.partitionBy("court").orderBy(F.desc("n"), "judge")
    return j.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


def seeded_sample(s: SparkSession, d: str) -> DataFrame:
    return ingest.seeded_sample(table(s, d, "metadata").select("rec_id", "court"), "rec_id", 50)


def manifest(s: SparkSession, d: str) -> DataFrame:
    """The manifest columns of the latest record of each case."""
    m = table(s, d, "metadata").withColumn("day", X.normal_date("decision_date")).where("cnr is not null and path is not null")
    one = windows.latest(m, ["cnr"], F.desc_nulls_last("day"), "rec_id")
    return one.select("cnr", F.col("title").alias("case_name"), "day", "judge", "court", F.col("path").alias("key"), X.base_name("path").alias("local_path"))


def resume_anti(s: SparkSession, d: str) -> DataFrame:
    """Judgments cited but not ingested at all: what a further fetch would take up."""
    from eralex.operators.references import key_of

    cited = table(s, d, "citations").select(key_of("cited_judgment_id").alias("key")).where("key is not null").distinct()
    return ingest.pending(cited, table(s, d, "judgments").select(key_of("judgment_id").alias("key")), "key")


def flags_json(s: SparkSession, d: str) -> DataFrame:
    """Free-form flags as a map: merged with a fixed entry, read back by key, and a JSON column parsed."""
    b = table(s, d, "bench_items")
    merged = F.map_concat(F.map_filter("validity_flags", lambda k, v: k != F.lit("checked")), F.create_map(F.lit("checked"), F.lit("yes")))
    return b.select("item_id", F.get(F.map_values(merged), F.size(F.map_keys(merged)) - 1).alias("checked"), F.try_element_at("validity_flags", F.lit("era_sensitive")).alias("era_sensitive"), F.size(merged).alias("n_flags"))


def event_props(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


def search_documents(s: SparkSession, d: str) -> DataFrame:
    """Both section sets in one corpus, and the unified documents by source."""
    c = table(s, d, "corpus").select(F.concat_ws("-", "statute", "section_no").alias("doc_id"), F.lit("statute").alias("source"), F.trim(F.concat_ws(" ", F.coalesce("marginal_note", F.lit("")), "text")).alias("text"))
    j = table(s, d, "dense_docs").where("source = 'judgment'").select("doc_id", "source", "text", "court")
    u = c.unionByName(j, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("court").alias("n_court"), F.sum((F.length("text") < 10).cast("int")).alias("n_short"), F.max(F.length("text")).alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (
        ingest_clean, ingest_rejected, ingest_summary, latest_per_key, date_texts, boolean_filter, skip_reasons, filter_if_any, filter_if_none, equality_filter, name_fallbacks, running_target, top_judges, seeded_sample,
        manifest, resume_anti, flags_json, event_props, search_documents,
    )
}

_REQ = "judgment_id case_name court date bench sections_cited text disposal".split()
_MISSING = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _REQ) + "], lambda x: x IS NOT NULL))"
VALIDATED = f"""chk AS (SELECT *, {_MISSING} AS missing, list_filter([
  CASE WHEN disposal NOT IN ('allowed', 'dismissed', 'partly allowed', 'remanded') THEN 'disposal not known: ' || disposal END,
  CASE WHEN len(sections_cited) = 0 THEN 'no section cited' END,
  CASE WHEN len(list_filter(sections_cited, lambda s: s.statute IS NULL OR s.section_no IS NULL)) > 0 THEN 'cited section without statute or number' END,
  CASE WHEN trim(text) = '' THEN 'blank text' END], lambda x: x IS NOT NULL) AS probs FROM judgments),
val AS (SELECT *, CASE WHEN len(missing) > 0 THEN 'no value: ' || array_to_string(missing, ', ') ELSE array_to_string(probs, '; ') END AS p0 FROM chk),
num AS (SELECT *, row_number() OVER (PARTITION BY judgment_id, p0 = '' ORDER BY ingested_at NULLS FIRST, case_name NULLS FIRST, text NULLS FIRST) AS rn FROM val),
cleanj AS (SELECT * FROM num WHERE p0 = '' AND rn = 1)"""
_DAY = "coalesce(CAST(try_strptime(substr(decision_date, 1, 10), '%Y-%m-%d') AS DATE), CAST(try_strptime(decision_date, '%d-%m-%Y') AS DATE))"
_LATEST = f"SELECT * FROM (SELECT *, {_DAY} AS day, row_number() OVER (PARTITION BY cnr ORDER BY {_DAY} DESC NULLS LAST, rec_id) AS rn FROM metadata WHERE cnr IS NOT NULL {{}}) WHERE rn = 1"
_SENS = "(?i)" + "|".join(X.SENSITIVE)

SQL = {
    "ingest_clean": f"WITH {VALIDATED} SELECT judgment_id, court, date, disposal, ingested_at, len(sections_cited)::INTEGER AS n_sections FROM cleanj",
    "ingest_rejected": f"WITH {VALIDATED} SELECT judgment_id, ingested_at, CASE WHEN p0 = '' THEN 'duplicate judgment_id' ELSE p0 END AS problems FROM num WHERE p0 <> '' OR rn > 1",
    "ingest_summary": f"WITH {VALIDATED} SELECT disposal, count(*) AS n, count(DISTINCT court) AS n_courts, min(date) AS first, max(date) AS last FROM cleanj GROUP BY disposal",
    "latest_per_key": f"SELECT cnr, rec_id, day FROM ({_LATEST.format('')})",
    "skip_reasons": f"""SELECT CASE WHEN path IS NULL OR trim(path) = '' THEN 'no file' WHEN description IS NULL THEN 'no text' WHEN length(trim(description)) < 100 THEN 'too short'
  WHEN coalesce(regexp_matches(title, '{_SENS}'), false) OR regexp_matches(substr(description, 1, 3000), '{_SENS}') THEN 'sensitive'
  WHEN NOT regexp_matches(description, '(?i)section [0-9]') THEN 'no sections' ELSE 'kept' END AS reason, count(*) AS n FROM metadata GROUP BY 1""",
    "filter_if_any": "SELECT rec_id, available_languages FROM metadata WHERE contains(lower(available_languages), 'english')",
    "boolean_filter": "SELECT item_id, true AS flagged FROM bench_items WHERE is_answerable UNION ALL SELECT item_id, false FROM bench_items",
    "date_texts": "SELECT rec_id, coalesce(CAST(coalesce(CAST(try_strptime(substr(decision_date, 1, 10), '%Y-%m-%d') AS DATE), CAST(try_strptime(decision_date, '%d-%m-%Y') AS DATE)) AS VARCHAR), decision_date) AS day FROM metadata",
    "filter_if_none": "SELECT rec_id, available_languages FROM metadata",
    "equality_filter": "SELECT rec_id, court FROM metadata WHERE lower(trim(feed)) = 'official'",
    "name_fallbacks": f"""SELECT rec_id, coalesce(nullif(trim(title), ''), nullif(trim(petitioner), '') || ' v. ' || nullif(trim(respondent), ''), 'Case ' || rec_id) AS case_name,
  coalesce(nullif(trim(cnr), ''), nullif(trim(case_id), ''), 'SC-' || year || '-' || rec_id) AS case_key, coalesce(nullif(trim(judge), ''), nullif(trim(author_judge), '')) AS judge,
  array_to_string([trim(x) FOR x IN string_split(judge, ',') IF trim(x) <> ''], '|') AS bench, list_last(string_split(path, '/')) AS file_name, {_DAY} AS day FROM metadata""",
    "running_target": "SELECT court, rec_id, before FROM (SELECT court, rec_id, row_number() OVER (PARTITION BY court ORDER BY scraped_at, rec_id) - 1 AS before FROM metadata WHERE court IS NOT NULL) WHERE before < 40",
    "top_judges": """SELECT * FROM (SELECT court, judge, n, row_number() OVER (PARTITION BY court ORDER BY n DESC, judge)::INTEGER AS rank
  FROM (SELECT court, judge, count(*) AS n FROM (SELECT court, unnest(bench) AS judge FROM judgments) GROUP BY ALL)) WHERE rank <= 3""",
    "seeded_sample": "SELECT rec_id, court FROM metadata ORDER BY md5(rec_id::VARCHAR || ':42'), rec_id LIMIT 50",
    "manifest": f"SELECT cnr, title AS case_name, day, judge, court, path AS key, list_last(string_split(path, '/')) AS local_path FROM ({_LATEST.format('AND path IS NOT NULL')})",
    "resume_anti": "SELECT DISTINCT upper(trim(cited_judgment_id)) AS key FROM citations WHERE trim(cited_judgment_id) <> '' AND upper(trim(cited_judgment_id)) NOT IN (SELECT upper(trim(judgment_id)) FROM judgments WHERE judgment_id IS NOT NULL)",
    "flags_json": "SELECT item_id, 'yes' AS checked, validity_flags['era_sensitive'] AS era_sensitive, (cardinality(validity_flags) + 1)::INTEGER AS n_flags FROM bench_items",
    "event_props": "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL",
    "search_documents": """WITH u AS (SELECT 'statute' AS source, trim(concat_ws(' ', coalesce(marginal_note, ''), text)) AS text, NULL AS court FROM corpus
  UNION ALL SELECT source, text, court FROM dense_docs WHERE source = 'judgment')
SELECT source, count(*) AS n, count(court) AS n_court, sum((length(text) < 10)::INT)::BIGINT AS n_short, max(length(text))::INTEGER AS longest FROM u GROUP BY source""",
}
