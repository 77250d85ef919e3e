"""Writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_split(df: DataFrame, condition: Column, kept: str, rest: str) -> None:
    """Rows that meet the condition and the others, each to its folder; null counts as not met. Without other rows theirs is not written."""
    marked = df.withColumn("__kept", F.coalesce(condition, F.lit(False)))
    marked.where("__kept").drop("__kept").write.mode("overwrite").parquet(kept)
    others = marked.where("not __kept").drop("__kept")
    if not others.isEmpty():
        others.write.mode("overwrite").parquet(rest)


def write_vectors(df: DataFrame, key: str, vec: str, docs: str, vectors: str) -> None:
    """Documents and their vectors side by side, joined by the key."""
    df.drop(vec).write.mode("overwrite").parquet(docs)
    df.select(key, vec).write.mode("overwrite").parquet(vectors)


def write_review(accepted: DataFrame, pending: DataFrame, trusted: str, review: str) -> None:
    """Decisions join the trusted mappings, and what is still open replaces the list to review.

    Both are new folders beside the ones that were read, so an interrupted run loses nothing.
    """
    accepted.write.mode("append").parquet(trusted)
    pending.write.mode("overwrite").parquet(review)


def report(df: DataFrame, rows: int = 100, digits: int = 4) -> str:
    """The first rows of a small result as text lines of even columns; ``df`` should be sorted."""
    shown = [[f"{v:.{digits}f}" if isinstance(v, float) else "-" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
    wide = [max(len(x) for x in c) for c in zip(df.columns, *shown)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in [df.columns, *shown])


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_noted(df: DataFrame, path: str, note: str) -> None:
    """With a provenance column."""
    df.withColumn("_note", F.lit(note)).write.mode("overwrite").parquet(path)


def append_missing(df: DataFrame, key: str, path: str) -> None:
    """Append rows whose key is not there yet: a run cut short can be started again."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return
    df.join(done, key, "left_anti").write.mode("append").parquet(path)
