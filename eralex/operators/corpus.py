"""Building the document sets that are searched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIFIED = "doc_id string, source string, text string, statute string, section_no string, judgment_id string, case_name string, court string, date date, rhetorical_unit string"


def build_corpus(sets: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, statute, section_no, marginal_note, text) of the section sets of several statutes; ids are statute and number."""
    parts = [
        df.select(F.concat(F.lit(f"{statute}-"), "section_no").alias("doc_id"), F.lit(statute).alias("statute"), "section_no", F.coalesce("marginal_note", F.lit("")).alias("marginal_note"), "text")
        for statute, df in sets.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def searched_text(note: Column, text: Column) -> Column:
    """A provision's text led by its marginal note."""
    return F.trim(F.concat_ws(" ", F.nullif(note, F.lit("")), text))


def unified_docs(corpus: DataFrame, chunks: DataFrame) -> DataFrame:
    """Statutes and judgment chunks under one schema, ``source`` telling which validity rule holds; no document at all is an error.

    chunks: (chunk_id, text, judgment_id, case_name, court, date, rhetorical_unit).
    """
    null = lambda c, t="string": F.lit(None).cast(t).alias(c)
    own = corpus.select(
        "doc_id", F.lit("statute").alias("source"), searched_text(F.col("marginal_note"), F.col("text")).alias("text"), "statute", "section_no",
        null("judgment_id"), null("case_name"), null("court"), null("date", "date"), null("rhetorical_unit"),
    )
    cut = chunks.select(
        F.col("chunk_id").alias("doc_id"), F.lit("judgment").alias("source"), "text", null("statute"), null("section_no"),
        "judgment_id", "case_name", "court", F.col("date").cast("date").alias("date"), "rhetorical_unit",
    )
    docs = own.unionByName(cut)
    if docs.isEmpty():
        raise ValueError("no statute and no judgment chunk to search")
    return docs
