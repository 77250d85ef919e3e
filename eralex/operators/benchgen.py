"""Building evaluation items, and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eralex.operators import validity
from eralex.operators.ingest import seeded_sample
from eralex.operators.references import key_of

CAPS = {"statutory": 100, "transition": 100, "precedent": 100, "trap": 50, "multihop": 50}
SLICES = list(CAPS)
SEED = 13
ITEM = "item_id string, slice string, question string, query_date date, gold_answer string, gold_evidence_ids array<string>, applicable_era string, is_answerable boolean"
REFUSAL = "Nothing of that name is on record; the right answer is a refusal."


def dated_items(qa: DataFrame) -> DataFrame:
    """qa: (id, query, query_date, gold_statute, gold_section_no) -> transition items, and statutory ones of the later half."""
    base = qa.select(
        F.col("id"), F.col("query").alias("question"), "query_date", F.concat_ws(" Section ", "gold_statute", "gold_section_no").alias("gold_answer"),
        F.array(F.concat_ws("-", "gold_statute", "gold_section_no")).alias("gold_evidence_ids"), F.col("gold_statute").alias("applicable_era"), F.lit(True).alias("is_answerable"),
    )
    transition = base.withColumn("slice", F.lit("transition")).withColumn("item_id", F.concat(F.lit("item_"), "id"))
    statutory = base.where(F.col("id").endswith("_post")).withColumn("slice", F.lit("statutory")).withColumn("item_id", F.concat(F.lit("item_"), "id", F.lit("_stat")))
    cap = lambda df, s: seeded_sample(df, "item_id", CAPS[s], SEED)
    return cap(transition, "transition").unionByName(cap(statutory, "statutory")).drop("id").select(*[c.split()[0] for c in ITEM.split(", ")])


def first_holding(chunks: DataFrame) -> DataFrame:
    """(jid, chunk_id, holding): the first holding chunk of each judgment."""
    h = chunks.where("rhetorical_unit = 'HOLDING' and text is not null").select(key_of("judgment_id").alias("jid"), F.struct("ord", F.col("doc_id").alias("chunk_id"), F.col("text").alias("holding")).alias("x"))
    return h.groupBy("jid").agg(F.min("x").alias("x")).select("jid", "x.chunk_id", "x.holding")


def precedent_items(judgments: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    j = judgments.select(key_of("judgment_id").alias("jid"), "case_name", F.date_add("date", 1).alias("query_date")).join(first_holding(chunks), "jid")
    g = validity.good_law(j, edges, "jid", "query_date")
    items = g.select(
        F.concat(F.lit("item_prec_"), "jid").alias("item_id"), F.lit("precedent").alias("slice"), F.concat(F.lit("What did the court hold in "), "case_name", F.lit("?")).alias("question"), "query_date",
        F.col("holding").alias("gold_answer"), F.array("chunk_id").alias("gold_evidence_ids"), F.lit("").alias("applicable_era"), F.lit(True).alias("is_answerable"), "good_law", "reason",
    )
    return items.orderBy("item_id").limit(CAPS["precedent"])


def multihop_items(judgments: DataFrame, chunks: DataFrame, edges: DataFrame, mapping: DataFrame) -> DataFrame:
    old = F.get(F.filter("sections_cited", lambda x: x["statute"] == "IPC"), F.lit(0))["section_no"]
    day = F.greatest(F.date_add("date", 730), F.lit(validity.CUT_OVER).cast("date"))
    j = judgments.select(key_of("judgment_id").alias("jid"), "case_name", old.alias("section"), day.alias("query_date")).where("section is not null")
    j = j.withColumn("k", F.upper(F.replace("section", F.lit(" "), F.lit("")))).join(mapping.select(F.col("ipc_section").alias("k"), "bns_section"), "k").join(first_holding(chunks), "jid")
    g = validity.good_law(j, edges, "jid", "query_date")
    standing = F.when(F.col("good_law"), F.lit("still good law")).otherwise(F.concat(F.lit("no longer good law ("), "reason", F.lit(")")))
    items = g.select(
        F.concat(F.lit("item_multihop_"), "jid").alias("item_id"), F.lit("multihop").alias("slice"),
        F.concat(F.lit("What section currently governs the offence discussed in "), "case_name", F.lit(", and is that case's holding still good law?")).alias("question"), "query_date",
        F.concat(F.lit("BNS Section "), "bns_section", F.lit(" (successor to IPC Section "), "section", F.lit("); the holding in "), "case_name", F.lit(" is "), standing, F.lit(".")).alias("gold_answer"),
        F.array(F.concat(F.lit("BNS-"), "bns_section"), "chunk_id").alias("gold_evidence_ids"), F.lit("BNS").alias("applicable_era"), F.lit(True).alias("is_answerable"), "good_law",
    )
    return items.orderBy("item_id").limit(CAPS["multihop"])


def trap_items(spark: SparkSession, sections: list[tuple[str, str]], cases: list[str], day: str) -> DataFrame:
    """Questions about sections and cases that do not exist; nothing may be cited for them."""
    rows = [(f"item_trap_sec_{s}_{n}", f"What is the punishment prescribed under Section {n} of the {s}?") for s, n in sections]
    rows += [(f"item_trap_case_{len(sections) + i}", f"What did the court hold in {c}?") for i, c in enumerate(cases)]
    made = spark.createDataFrame(rows, "item_id string, question string")
    return made.select("item_id", F.lit("trap").alias("slice"), "question", F.lit(day).cast("date").alias("query_date"), F.lit(REFUSAL).alias("gold_answer"), F.array().cast("array<string>").alias("gold_evidence_ids"), F.lit("").alias("applicable_era"), F.lit(False).alias("is_answerable")).limit(CAPS["trap"])


def item_problems(items: DataFrame) -> DataFrame:
    """(item_id, problem) of items that break an invariant."""
    some = F.coalesce(F.size("gold_evidence_ids"), F.lit(0)) > 0
    checks = F.array(
        F.when(~F.col("slice").isin(SLICES), F.lit("unknown slice")),
        F.when((F.col("slice") == "trap") & some, F.lit("trap item with evidence")),
        F.when((F.col("slice") != "trap") & ~some, F.lit("no gold evidence")),
    )
    own = items.select("item_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("problem"))
    twice = items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").select("item_id", F.lit("duplicate item_id").alias("problem"))
    return own.unionByName(twice)
