"""Which law, and which precedent, was in force on a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralex.functions.text import col
from eralex.operators.references import key_of

CUT_OVER = "2024-07-01"
DEMOTION = 0.05
INVALIDATING = ["overruled", "reversed"]


def statute_on(d: str | Column, cut_over: str = CUT_OVER) -> Column:
    return F.when(col(d) < F.lit(cut_over).cast("date"), F.lit("IPC")).otherwise(F.lit("BNS"))


def demoted(score: Column, wrong: Column, by: float = DEMOTION) -> Column:
    return F.when(F.coalesce(wrong, F.lit(False)), score * by).otherwise(score)


def rerank(df: DataFrame, score: str, *ties: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(score), *ties)))


def citation_edges(citations: DataFrame, judgments: DataFrame) -> DataFrame:
    """(target, citing, inv_on, signal, edge_ord, invalidates): resolved citations with the citing date."""
    j = judgments.select(key_of("judgment_id").alias("jid"), F.col("date").alias("inv_on"))
    c = citations.select(key_of("cited_judgment_id").alias("target"), key_of("citing_judgment_id").alias("citing"), "signal", F.col("citation_id").alias("edge_ord"))
    known = c.join(j.select(F.col("jid").alias("target")), "target", "left_semi")
    return known.join(j, known.citing == j.jid).select("target", "citing", "inv_on", "signal", "edge_ord", F.col("signal").isin(INVALIDATING).alias("invalidates"))


def good_law(asked: DataFrame, edges: DataFrame, jid: str, day: str) -> DataFrame:
    """``asked`` with good_law and reason: the first invalidating edge in list order that is not later than the day.

    Edges of one target and day are folded into their first before the inequality
    join, so a landmark's many edges do not meet its many queries one by one.
    """
    bad = edges.where("invalidates and inv_on is not null")
    reason = F.concat("signal", F.lit(" by "), "citing", F.lit(" on "), F.col("inv_on").cast("string"))
    first = bad.groupBy("target", "inv_on").agg(F.min(F.struct("edge_ord", reason.alias("reason"))).alias("e"))
    keys = asked.select(jid, day).distinct()
    hit = keys.join(first, (keys[jid] == first.target) & (first.inv_on <= keys[day])).groupBy(jid, day).agg(F.min("e").alias("e"))
    return asked.join(hit, [jid, day], "left").withColumn("good_law", F.col("e").isNull()).withColumn("reason", F.col("e.reason")).drop("e")


def notice(statute: Column, section: Column, day: Column, successor: Column, cut_over: str = CUT_OVER) -> Column:
    """What must be said of a provision on a date, or null. The sentences are fixed values that results must equal."""
    wrong = F.concat(statute, F.lit(" Section "), section, F.lit(" was "), F.when(statute == "IPC", "repealed").otherwise("not yet in force"), F.lit(" as of "), day.cast("string"), F.lit(f" (BNS commencement date: {cut_over})."))
    moved = F.concat(F.lit("IPC Section "), section, F.lit(f" was repealed w.e.f. {cut_over}; corresponding current provision is BNS Section "), successor, F.lit("."))
    return F.when(statute != statute_on(day, cut_over), wrong).when((statute == "IPC") & successor.isNotNull(), moved)
