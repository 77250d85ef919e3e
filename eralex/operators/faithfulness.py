"""Support of claims by the documents they cite, and prompts with numbered documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralex.functions import text as X


def claim_rows(answers: DataFrame, answer_id: str, answer: str) -> DataFrame:
    """(answer_id, claim_no, claim, cited)."""
    return answers.select(F.col(answer_id).alias("answer_id"), F.posexplode(X.claims(answer)).alias("claim_no", "c")).select("answer_id", "claim_no", "c.claim", "c.cited")


def claim_support(answers: DataFrame, answer_id: str, answer: str, docs: DataFrame, entails: Callable[[Column, Column], Column] = X.supported) -> DataFrame:
    """(answer_id, claim_no, n_cited, supported). docs: (answer_id, n, text).

    A cited number without a document adds nothing; texts are joined in the order of citing.
    Any entailment model can take the place of word overlap.
    """
    c = claim_rows(answers, answer_id, answer)
    one = c.select("answer_id", "claim_no", "claim", "cited", F.posexplode_outer("cited").alias("pos", "n"))
    joined = one.join(docs.select("answer_id", "n", "text"), ["answer_id", "n"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ")
    grouped = joined.groupBy("answer_id", "claim_no", "claim").agg(F.count("n").cast("int").alias("n_cited"), text.alias("source"))
    return grouped.select("answer_id", "claim_no", "n_cited", F.when(F.col("n_cited") > 0, entails(F.col("claim"), F.col("source"))).alias("supported"))


def faithfulness(support: DataFrame) -> DataFrame:
    """(answer_id, n_claims, n_cited, precision, recall); null precision without cited claims."""
    cited, ok = F.count(F.when(F.col("n_cited") > 0, 1)), F.count(F.when(F.col("supported"), 1))
    return support.groupBy("answer_id").agg(F.count("*").alias("n_claims"), cited.alias("n_cited"), F.round(F.try_divide(ok, cited), 6).alias("precision"), F.round(ok / F.count("*"), 6).alias("recall"))


def prompts(results: DataFrame, notices: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, prompt). results: (query_id, rank, statute, section_no, text). The headers are fixed values that results must equal."""
    block = F.concat(F.lit("[Doc "), F.col("rank").cast("string"), F.lit("] "), "statute", F.lit(" Section "), "section_no", F.lit("\n"), "text")
    docs = results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("docs"))
    j = docs.join(notices.select("query_id", "notices"), "query_id", "left").join(questions.select("query_id", "question"), "query_id")
    verified = F.when(F.col("notices").isNotNull(), F.concat(F.lit("\n\nSYSTEM-VERIFIED VALIDITY NOTICES:\n"), "notices")).otherwise(F.lit(""))
    return j.select("query_id", F.concat(F.lit("Documents:\n\n"), "docs", verified, F.lit("\n\nQuestion: "), "question").alias("prompt"))


def answer_rates(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of rates. answers: (answer_id, answer, gold_statute, gold_section, notice); docs: (answer_id, n, statute, section_no)."""
    a = answers.withColumn("cited", X.cited_numbers("answer"))
    hit = a.select("answer_id", F.explode("cited").alias("n"), "gold_statute", "gold_section").join(docs, ["answer_id", "n"])
    right = hit.where((F.col("statute") == F.col("gold_statute")) & (X.base_section("section_no") == X.base_section("gold_section"))).select("answer_id").distinct().withColumn("right", F.lit(True))
    j = a.join(right, "answer_id", "left")
    expected = F.coalesce(F.col("notice") != "", F.lit(False))
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return j.agg(
        F.count("*").alias("n"),
        rate(F.coalesce("right", F.lit(False))).alias("citation_accuracy"),
        rate(F.size("cited") == 0).alias("no_citation"),
        rate(X.abstains("answer")).alias("abstained"),
        F.round(F.try_divide(F.count(F.when(expected & X.surfaces_notice("answer"), 1)), F.count(F.when(expected, 1))), 6).alias("notice_surfaced"),
    )
