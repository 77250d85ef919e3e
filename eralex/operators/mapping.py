"""Reconciling conflicting mappings by weighted vote, review and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eralex.functions.text import base_section, normal_section

OFFICIAL, OTHER = 2, 1


def tally(votes: DataFrame, official: str) -> DataFrame:
    """(ipc_section, bns_section, votes, sources, first_description, first_key, top, total, at_top)."""
    weighted = votes.withColumn("ipc_section", normal_section("ipc_section")).withColumn("w", F.when(F.col("source") == official, OFFICIAL).otherwise(OTHER))
    per = weighted.groupBy("ipc_section", "bns_section").agg(
        F.sum("w").cast("long").alias("votes"), F.array_sort(F.collect_set("source")).alias("sources"), F.min(F.struct("vote_key", "description")).alias("f")
    )
    w = W.partitionBy("ipc_section")
    out = per.withColumn("top", F.max("votes").over(w)).withColumn("total", F.sum("votes").over(w))
    return out.withColumn("at_top", F.sum((F.col("votes") == F.col("top")).cast("int")).over(w)).select("*", F.col("f.description").alias("description")).drop("f")


def majority(t: DataFrame) -> DataFrame:
    return t.withColumn("decided", (F.col("top") >= 2) & (F.col("at_top") == 1) & (F.col("top") * 2 > F.col("total")))


def trusted(votes: DataFrame, official: str) -> DataFrame:
    """One mapping per decided section, with its tally."""
    t = majority(tally(votes, official)).where("decided")
    tallies = t.groupBy("ipc_section").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "bns_section", F.col("votes").cast("string")))), ";").alias("tally"))
    win = t.where("votes = top").select("ipc_section", "bns_section", "description", F.array_join("sources", ";").alias("sources"), "votes")
    return win.join(tallies, "ipc_section")


def review(votes: DataFrame, official: str) -> DataFrame:
    """(ipc_section, reason, candidates) of undecided sections."""
    t = majority(tally(votes, official)).where("not decided")
    reason = F.when(F.max("at_top") > 1, "tied_disagreement").otherwise("tie_or_single_source")
    return t.groupBy("ipc_section").agg(reason.alias("reason"), F.array_sort(F.collect_list("bns_section")).alias("candidates"))


def apply_review(pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, remaining). decisions: (ipc_section, seq, choice): an index accepts, "q" ends, all else skips."""
    stop = decisions.where("choice = 'q'").agg(F.min("seq")).scalar()
    open_ = decisions.where(stop.isNull() | (F.col("seq") < stop))
    joined = pending.join(open_.select("ipc_section", "choice"), "ipc_section", "left")
    index = F.expr("try_cast(choice as int)")
    chosen = joined.withColumn("bns_section", F.when(index >= 0, F.get("candidates", index)))
    return chosen.where("bns_section is not null").select("ipc_section", "bns_section"), chosen.where("bns_section is null").select("ipc_section", "reason")


def coverage(mapping: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """mapping with flags whether a text of either section exists."""
    o = old.select(base_section("section_no").alias("ko")).distinct().withColumn("ipc_text_available", F.lit(True))
    n = new.select(base_section("section_no").alias("kn")).distinct().withColumn("bns_text_available", F.lit(True))
    j = mapping.join(o, base_section("ipc_section") == F.col("ko"), "left").join(n, base_section("bns_section") == F.col("kn"), "left").drop("ko", "kn")
    return j.withColumn("ipc_text_available", F.coalesce("ipc_text_available", F.lit(False))).withColumn("bns_text_available", F.coalesce("bns_text_available", F.lit(False)))
