"""Queries of segmentation, citations and sections in texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.functions import text as X
from eralex.config import Settings
from eralex.operators import chunking, corpus, resolve, segment
from eralex.plans.ingest import VALIDATED, clean_judgments
from eralex.runtime import table


def segment_lines(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(clean_judgments(s, d).select("judgment_id", "text"), "judgment_id", "text")


def _headed(s: SparkSession, d: str) -> DataFrame:
    """Judgments with headings; those of even length lack one."""
    j = clean_judgments(s, d)
    issue = F.when(F.length("text") % 2 == 0, F.lit("\nPoint: ")).otherwise(F.lit("\nIssue: "))
    text = F.concat(F.lit("FACTS: "), "case_name", issue, "court", F.lit("\nREASONING: "), F.substring_index("text", "\n", 1), F.lit("\nHOLDING: "), "disposal")
    return j.select("judgment_id", text.alias("text"))


def heading_split(s: SparkSession, d: str) -> DataFrame:
    return segment.segments(_headed(s, d), "judgment_id", "text").where("method = 'headings'").select("judgment_id", "rhetorical_unit", "text")


def reasoning_and_holding(s: SparkSession, d: str) -> DataFrame:
    h = X.split_by_headings("text")
    picked = F.when(h.isNotNull(), F.concat_ws(" ", F.get(h, F.lit(2))["text"], F.get(h, F.lit(3))["text"])).otherwise(F.col("text"))
    return _headed(s, d).select("judgment_id", F.length(picked).alias("n"))


def case_mentions(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "dense_docs").where("text is not null").select("ord", F.explode(X.case_mentions("text")).alias("m"), X.signal_of("text").alias("signal"))
    return m.select("ord", F.col("m.name").alias("name"), F.col("m.year").alias("year"), "signal")


def signal_class(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "citations")
    return c.groupBy("signal", X.signal_of(F.coalesce("context", F.lit(""))).alias("read")).agg(F.count("*").alias("n"))


def resolve_names(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "citations").where("cited_case_name is not null")
    names = c.select(X.normal_name("cited_case_name").alias("name"), F.trim("cited_year").alias("year")).where("year is not null").distinct()
    return resolve.resolve(names, resolve.name_index(clean_judgments(s, d)))


def chunk_fixed(s: SparkSession, d: str) -> DataFrame:
    c = chunking.fixed_windows(table(s, d, "dense_docs").where("text is not null").select("ord", "doc_id", "text"), "doc_id", "text", Settings.read(s).chunk_words)
    return c.select("ord", "chunk_doc_id", "parent_doc_id", F.md5("text").alias("text_md5"))


def numbered_sections(s: SparkSession, d: str) -> DataFrame:
    x = table(s, d, "dense_docs").where("text is not null").select("ord", F.posexplode(X.split_numbered("text")).alias("pos", "x"))
    return x.select("ord", "pos", "x.section_no", F.length("x.text").alias("n"), (F.length("x.text") < 10).alias("needs_review"))


def titled_sections(s: SparkSession, d: str) -> DataFrame:
    """Provisions written as "NUM. Title--text" and split again; the second follows an amendment's "1*[" and a running header."""
    note = F.coalesce(F.nullif(F.trim("marginal_note"), F.lit("")), F.lit("Note"))
    c = table(s, d, "corpus").where("text is not null").select("ord", F.concat(F.lit("7. "), note, F.lit("--"), "text", F.lit("\n1*[8A. Part II of Rules 8A. "), note, F.lit("-"), note, F.lit("  applies\nnow")).alias("t"))
    return c.select("ord", F.explode(X.split_titled("t")).alias("x")).select("ord", "x.section_no", "x.title", F.length("x.text").alias("n"))


def parse_cells(s: SparkSession, d: str) -> DataFrame:
    j = table(s, d, "judgments").select(F.explode("sections_cited").alias("c"), "disposal").select(F.concat("c.section_no", F.lit(" . "), F.coalesce("disposal", F.lit("x")), F.lit("..")).alias("cell")).distinct()
    return j.select("cell", X.parse_cell("cell").alias("p")).select("cell", "p.section", "p.description")


def sections_in_text(s: SparkSession, d: str) -> DataFrame:
    j = clean_judgments(s, d)
    lead = F.concat(F.lit("Charged under Sections "), F.array_join(F.transform("sections_cited", lambda x: x["section_no"]), ", "), F.lit(" of the Indian Penal Code read with u/s 61 BNS. "))
    return j.select("judgment_id", F.explode(X.sections_cited(F.concat(lead, "text"))).alias("c")).select("judgment_id", "c.statute", "c.section_no")


def cleaned_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages with a cover, footnotes and a section that goes on after them: extracted, cleaned and split."""
    c = table(s, d, "corpus").where("text is not null")
    text = F.concat(F.lit("Cover of the code\f"), "text", F.lit("\n------------\n1. Subs. by a later law\nand so on\n13A.\nkept line\f\n77. Last page"))
    return c.select("ord", segment.clean_pages(text, 1).alias("t")).select("ord", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


def built_corpus(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "corpus").where("text is not null")
    made = corpus.build_corpus({x: c.where(F.col("statute") == x) for x in ("IPC", "BNS")})
    return made.select("doc_id", "statute", "section_no", "marginal_note", F.md5("text").alias("text_md5"))


def unified_docs(s: SparkSession, d: str) -> DataFrame:
    """Sections and segmented judgments as one document set."""
    j = clean_judgments(s, d)
    chunks = segment.segments(j.select("judgment_id", "text"), "judgment_id", "text").join(j.select("judgment_id", "case_name", "court", "date"), "judgment_id")
    return corpus.unified_docs(table(s, d, "corpus"), chunks).select("doc_id", "source", "statute", "section_no", "judgment_id", "case_name", "court", "date", "rhetorical_unit", F.md5("text").alias("text_md5"))


def disposal_read(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dense_docs").where("text is not null").select(X.disposal_of("text").alias("disposal")).groupBy("disposal").agg(F.count("*").alias("n"))


def line_units(s: SparkSession, d: str) -> DataFrame:
    """Units by cue phrases of all judgment chunks against the stored unit."""
    c = table(s, d, "dense_docs").where("source = 'judgment' and text is not null")
    return c.groupBy("rhetorical_unit", X.rhetorical_unit("text").alias("read")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (segment_lines, heading_split, reasoning_and_holding, case_mentions, signal_class, resolve_names, chunk_fixed, numbered_sections, titled_sections, parse_cells, sections_in_text, cleaned_pages, built_corpus, unified_docs, disposal_read, line_units)
}


def _unit(c: str) -> str:
    score = {h: " + ".join(f"contains({c}, '{q}')::INT" for q in X.CUES[h]) for h in X.HEADINGS}
    top = "greatest(" + ", ".join(f"({v})" for v in score.values()) + ")"
    return f"CASE WHEN {top} = 0 THEN 'REASONING' " + " ".join(f"WHEN ({score[h]}) = {top} THEN '{h}'" for h in X.HEADINGS) + " END"


def _signal(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{n}'" for n, p in X.SIGNALS) + " ELSE 'cited' END"


def _name(c: str) -> str:
    return rf"regexp_replace(replace(replace(lower(trim({c})), 'vs.', 'v.'), ' v ', ' v. '), '\s+', ' ', 'g')"


_HEADED = f"""{VALIDATED}, hd AS (SELECT judgment_id, case_name, court, string_split(text, chr(10))[1] AS r, disposal, length(text) % 2 = 1 AS ok,
  'FACTS: ' || case_name || CASE WHEN length(text) % 2 = 0 THEN chr(10) || 'Point: ' ELSE chr(10) || 'Issue: ' END || court || chr(10) || 'REASONING: ' || string_split(text, chr(10))[1] || chr(10) || 'HOLDING: ' || disposal AS t FROM cleanj)"""
_SP = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"



def _sections_sql() -> str:
    """Numbers after the first trigger in the 200 characters before each name of a statute."""
    parts = []
    for statute, names in X.STATUTES.items():
        parts.append(rf"""SELECT judgment_id, '{statute}' AS statute, unnest(nums) AS section_no FROM (
  SELECT judgment_id, regexp_extract_all(regexp_extract(w, '(?s){X.SECTION_TRIGGER}(.*)', 1), '{X.SECTION_NUMBER}') AS nums FROM (
    SELECT judgment_id, right(array_to_string([p[j] || n[j] FOR j IN range(1, i)], '') || p[i], {X.BACK_WINDOW}) AS w FROM (
      SELECT judgment_id, p, n, unnest(range(1, len(n) + 1)) AS i FROM (
        SELECT judgment_id, string_split_regex(t, '(?i)(?:{names})') AS p, regexp_extract_all(t, '(?i)({names})', 1) AS n FROM lt))))""")
    return f"""WITH {VALIDATED}, lt AS (SELECT judgment_id, 'Charged under Sections ' || array_to_string([x.section_no FOR x IN sections_cited], ', ') || ' of the Indian Penal Code read with u/s 61 BNS. ' || text AS t FROM cleanj)
SELECT DISTINCT * FROM ({" UNION ALL ".join(parts)})"""


SQL = {
    "segment_lines": rf"""WITH {VALIDATED}, hp AS (SELECT judgment_id, text, list_transform(regexp_extract_all(text, '(?i)(?:^|\n)(FACTS|ISSUE|REASONING|HOLDING):\s*', 1), lambda x: upper(x)) = ['FACTS', 'ISSUE', 'REASONING', 'HOLDING'] AS ok FROM cleanj),
sp AS (SELECT judgment_id, string_split_regex(text, '(?i)(?:^|\n)(?:FACTS|ISSUE|REASONING|HOLDING):\s*') AS ps FROM hp WHERE ok),
hx AS (SELECT judgment_id, unnest(['FACTS', 'ISSUE', 'REASONING', 'HOLDING']) AS u, unnest([trim(ps[2]), trim(ps[3]), trim(ps[4]), trim(ps[5])]) AS text FROM sp),
l AS (SELECT judgment_id, unnest(range(len(ls))) AS pos, unnest(ls) AS text FROM (SELECT judgment_id, [trim(x) FOR x IN string_split(text, chr(10)) IF trim(x) <> ''] AS ls FROM hp WHERE NOT ok)),
u AS (SELECT *, lower(text) AS lt FROM l)
SELECT judgment_id, {_unit("lt")} AS rhetorical_unit, 'cues' AS method, text, judgment_id || '::' || {_unit("lt")} || '::' || pos AS chunk_id FROM u
UNION ALL SELECT judgment_id, u, 'headings', text, judgment_id || '::' || u || '::0' FROM hx""",
    "heading_split": f"""WITH {_HEADED} SELECT judgment_id, unnest(['FACTS', 'ISSUE', 'REASONING', 'HOLDING']) AS rhetorical_unit, unnest([trim(case_name), trim(court), trim(r), trim(disposal)]) AS text FROM hd WHERE ok""",
    "reasoning_and_holding": f"WITH {_HEADED} SELECT judgment_id, length(CASE WHEN ok THEN trim(r) || ' ' || trim(disposal) ELSE t END)::INTEGER AS n FROM hd",
    "case_mentions": f"""WITH m AS (SELECT ord, text, unnest(regexp_extract_all(text, '{X.CASE_MENTION}', 1)) AS name, unnest(regexp_extract_all(text, '{X.CASE_MENTION}', 2)) AS year FROM dense_docs WHERE text IS NOT NULL)
SELECT ord, trim(name) AS name, year, {_signal("text")} AS signal FROM m""",
    "signal_class": f"SELECT signal, {_signal("coalesce(context, '')")} AS read, count(*) AS n FROM citations GROUP BY ALL",
    "resolve_names": f"""WITH {VALIDATED}, ix0 AS (SELECT trim(replace({_name("case_name")}, '(review)', '')) AS name, year(date)::VARCHAR AS year, judgment_id, ingested_at FROM cleanj),
ix AS (SELECT name, year, arg_max(judgment_id, (ingested_at, judgment_id)) AS jid FROM ix0 GROUP BY ALL),
nm AS (SELECT DISTINCT {_name("cited_case_name")} AS name, trim(cited_year) AS year FROM citations WHERE cited_case_name IS NOT NULL AND cited_year IS NOT NULL),
ex AS (SELECT n.*, i.jid FROM nm n LEFT JOIN ix i USING (name, year)),
fz AS (SELECT e.name, e.year, min(i.jid) AS jid FROM ex e JOIN ix i ON e.year = i.year AND (contains(i.name, e.name) OR contains(e.name, i.name)) WHERE e.jid IS NULL AND length(e.name) >= 5 AND length(i.name) >= 5 GROUP BY ALL HAVING count(DISTINCT i.jid) = 1)
SELECT e.name, e.year, coalesce(e.jid, f.jid) AS jid, CASE WHEN e.jid IS NOT NULL THEN 1 WHEN f.jid IS NOT NULL THEN 2 ELSE 0 END AS tier FROM ex e LEFT JOIN fz f ON e.name = f.name AND e.year = f.year""",
    "chunk_fixed": f"""WITH w AS (SELECT ord, doc_id, text, regexp_extract_all(text, '[^{_SP}]+') AS ws FROM dense_docs WHERE text IS NOT NULL),
l AS (SELECT *, unnest(range((len(ws) - 1) // 512 + 1)) AS k FROM w WHERE len(ws) > 512)
SELECT ord, doc_id AS chunk_doc_id, doc_id AS parent_doc_id, md5(text) AS text_md5 FROM w WHERE len(ws) <= 512
UNION ALL SELECT ord, doc_id || '::w' || k, doc_id, md5(array_to_string(ws[k * 512 + 1:k * 512 + 512], ' ')) FROM l""",
    "numbered_sections": r"""WITH m AS (SELECT ord, regexp_replace(text, '(?:^|\n)(\d{1,3}[A-Z]{0,2})\.\s*([A-Z(“"])', chr(1) || '\1' || chr(2) || '\2', 'g') AS t FROM dense_docs WHERE text IS NOT NULL),
p AS (SELECT ord, string_split(t, chr(1))[2:] AS ps FROM m), e AS (SELECT ord, unnest(range(len(ps))) AS pos, unnest(ps) AS x FROM p),
b AS (SELECT ord, pos::INTEGER AS pos, split_part(x, chr(2), 1) AS section_no, trim(regexp_replace(split_part(x, chr(2), 2), '[%s]+', ' ', 'g')) AS body FROM e)
SELECT ord, pos, section_no, length(body)::INTEGER AS n, length(body) < 10 AS needs_review FROM b""" % _SP,
    "titled_sections": f"""WITH c AS (SELECT ord, text, coalesce(nullif(trim(marginal_note), ''), 'Note') AS title FROM corpus WHERE text IS NOT NULL)
SELECT ord, '7' AS section_no, title, length(trim(regexp_replace(text, '[{_SP}]+', ' ', 'g')))::INTEGER AS n FROM c UNION ALL SELECT ord, '8A', title, length(title || ' applies now')::INTEGER FROM c""",
    "cleaned_pages": "WITH c AS (SELECT ord, text || chr(10) || '13A.' || chr(10) || 'kept line' || chr(10) || chr(10) || '77. Last page' AS t FROM corpus WHERE text IS NOT NULL) SELECT ord, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM c",
    "built_corpus": "SELECT statute || '-' || section_no AS doc_id, statute, section_no, coalesce(marginal_note, '') AS marginal_note, md5(text) AS text_md5 FROM corpus WHERE text IS NOT NULL AND statute IN ('IPC', 'BNS')",
    "sections_in_text": _sections_sql(),
    "parse_cells": r"""WITH c AS (SELECT DISTINCT c.section_no || ' . ' || coalesce(disposal, 'x') || '..' AS cell FROM (SELECT unnest(sections_cited) AS c, disposal FROM judgments)),
x AS (SELECT cell, trim(cell) AS t, '^(\d+[A-Za-z]{0,3})((?:\s*\([A-Za-z0-9]{1,5}\))*)\s*\.?\s*(.*)$' AS p FROM c)
SELECT cell, CASE WHEN regexp_matches(t, p) THEN regexp_extract(t, p, 1) || replace(regexp_extract(t, p, 2), ' ', '') END AS section, CASE WHEN regexp_matches(t, p) THEN regexp_replace(trim(regexp_extract(t, p, 3)), '\.+$', '') END AS description FROM x""",
    "disposal_read": "SELECT CASE " + " ".join(f"WHEN contains(lower(right(text, 1500)), '{k}') THEN '{v}'" for k, v in X.DISPOSALS) + " ELSE 'dismissed' END AS disposal, count(*) AS n FROM dense_docs WHERE text IS NOT NULL GROUP BY 1",
    "line_units": f"SELECT rhetorical_unit, {_unit('lower(text)')} AS read, count(*) AS n FROM dense_docs WHERE source = 'judgment' AND text IS NOT NULL GROUP BY ALL",
}

_head, _body = SQL["segment_lines"].split("\nSELECT judgment_id, ", 1)
SQL["unified_docs"] = f"""{_head}, sg AS (SELECT judgment_id, {_body})
SELECT doc_id, 'statute' AS source, statute, section_no, NULL AS judgment_id, NULL AS case_name, NULL AS court, NULL::DATE AS date, NULL AS rhetorical_unit, md5(trim(concat_ws(' ', nullif(marginal_note, ''), text))) AS text_md5 FROM corpus
UNION ALL SELECT chunk_id, 'judgment', NULL, NULL, judgment_id, case_name, court, date, rhetorical_unit, md5(sg.text) FROM sg JOIN (SELECT judgment_id, case_name, court, date FROM cleanj) USING (judgment_id)"""
