"""Cutting judgments into rhetorical units, and pages into sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralex.functions.text import BARE_SECTION, FOOTNOTES, rhetorical_unit, split_by_headings


def segments(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, chunk_id, rhetorical_unit, method, text): by headings where all four stand, else by lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    unit = "struct<unit:string,text:string>"
    by_line = F.transform(lines, lambda x: F.struct(F.lit(None).cast("string").alias("unit"), x.alias("text")).cast(unit))
    heads = split_by_headings(text)
    marked = df.select(doc_id, heads.isNotNull().alias("__headed"), F.coalesce(heads.cast(f"array<{unit}>"), by_line).alias("__u"))
    each = marked.select(doc_id, "__headed", F.posexplode("__u").alias("pos", "u"))
    unit = F.coalesce("u.unit", rhetorical_unit("u.text"))
    each = each.select(doc_id, F.when(F.col("__headed"), 0).otherwise(F.col("pos")).alias("pos"), unit.alias("rhetorical_unit"), F.when(F.col("__headed"), "headings").otherwise("cues").alias("method"), F.col("u.text").alias("text"))
    return each.withColumn("chunk_id", F.concat_ws("::", doc_id, "rhetorical_unit", F.col("pos").cast("string"))).drop("pos")


def clean_page(c):
    """A page without the footnotes below its divider; text after a bare section number is kept."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.split(c, FOOTNOTES, 2)
    lines = F.split(F.get(parts, F.lit(1)), "\n")
    bare = lambda x: F.trim(x).rlike(BARE_SECTION)
    at = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("i"), F.lit(-1).alias("k")),
        lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when((s["k"] < 0) & bare(x), s["i"]).otherwise(s["k"]).alias("k")),
        lambda s: s["k"],
    )
    kept = F.when(at >= 0, F.array_join(F.slice(lines, at + 1, F.size(lines)), "\n")).otherwise(F.lit(""))
    return F.when(F.size(parts) < 2, c).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit("\n"), kept))


def clean_pages(text, start_page: int = 0):
    """Pages of an extracted document, divided by form feeds, from ``start_page`` on and each without its footnotes."""
    t = F.col(text) if isinstance(text, str) else text
    pages = F.split(t, "\f")
    return F.array_join(F.transform(F.slice(pages, start_page + 1, F.size(pages)), clean_page), "\n")
