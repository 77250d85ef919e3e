"""Fixed windows of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eralex.functions.text import words

WINDOW = 512


def fixed_windows(df: DataFrame, doc_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """``df`` with chunk_doc_id, parent_doc_id and the window as ``text``; a text within the size stays as it is."""
    w = df.withColumn("__w", words(F.coalesce(text, F.lit(""))))
    starts = F.sequence(F.lit(0), F.floor((F.size("__w") - 1) / size).cast("int"))
    long = F.size("__w") > size
    cut = w.withColumn("__k", F.explode(F.when(long, starts).otherwise(F.array(F.lit(0)))))
    window = F.array_join(F.slice("__w", F.col("__k") * size + 1, size), " ")
    chunk = F.concat(F.col(doc_id), F.lit("::w"), F.col("__k").cast("string"))
    # a text within the size keeps its white space
    cut = cut.withColumn(text, F.when(long, window).otherwise(F.col(text))).withColumn("chunk_doc_id", F.when(long, chunk).otherwise(F.col(doc_id)))
    return cut.drop("__w", "__k").withColumn("parent_doc_id", F.col(doc_id))
