"""Validation of records, with reasons for every reject, and filters of the fetch stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The fields and outcomes that a judgment must have.
REQUIRED = ["judgment_id", "case_name", "court", "date", "bench", "sections_cited", "text", "disposal"]
VALID_DISPOSALS = ["allowed", "dismissed", "partly allowed", "remanded"]


def problems(df: DataFrame) -> Column:
    """array<string> of what is wrong with a judgment; missing fields end the checks."""
    missing = F.array_sort(F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull()))
    checks = F.array(
        F.when(~F.col("disposal").isin(VALID_DISPOSALS), F.concat(F.lit("disposal not known: "), "disposal")),
        F.when(F.size("sections_cited") == 0, F.lit("no section cited")),
        F.when(F.exists("sections_cited", lambda s: s["statute"].isNull() | s["section_no"].isNull()), F.lit("cited section without statute or number")),
        F.when(F.trim("text") == "", F.lit("blank text")),
    )
    return F.when(F.size(missing) > 0, F.array(F.concat(F.lit("no value: "), F.array_join(missing, ", ")))).otherwise(F.filter(checks, lambda x: x.isNotNull()))


def validated(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with problems; among valid rows of one id all but the first in order are duplicates."""
    checked = df.withColumn("problems", problems(df)).withColumn("__ok", F.size("problems") == 0)
    w = W.partitionBy("judgment_id", "__ok").orderBy(*order)
    numbered = checked.withColumn("__rn", F.when(F.col("__ok"), F.row_number().over(w)))
    return numbered.withColumn("problems", F.when(F.col("__rn") > 1, F.array(F.lit("duplicate judgment_id"))).otherwise(F.col("problems"))).drop("__ok", "__rn")


def clean(df: DataFrame, order: list[str]) -> DataFrame:
    """First valid row of each id. The rank filter runs before the shuffle, so a hot id shrinks to one row a task."""
    ok = df.where(F.size(problems(df)) == 0)
    return ok.withColumn("__rn", F.row_number().over(W.partitionBy("judgment_id").orderBy(*order))).where("__rn = 1").drop("__rn")


def rejected(df: DataFrame, order: list[str]) -> DataFrame:
    return validated(df, order).where(F.size("problems") > 0)


def filter_if_any(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that meet the condition if any row does, else all rows."""
    met = F.coalesce(condition, F.lit(False))
    some = df.agg(F.coalesce(F.max(met), F.lit(False))).scalar()
    return df.where(~some | met)


def equals_if_there(df: DataFrame, column: str, value: str) -> DataFrame:
    """Equality on a trimmed lower-case column, when the source has that column."""
    return df.where(F.lower(F.trim(column)) == value) if column in df.columns else df


def true_if_there(df: DataFrame, column: str) -> DataFrame:
    """Rows whose flag is set, when the source has that flag; null counts as not set."""
    return df.where(F.coalesce(F.col(column), F.lit(False))) if column in df.columns else df


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that fails, null when none does."""
    out = F.when(F.lit(False), F.lit(""))
    for name, bad in checks:
        out = out.when(F.coalesce(bad, F.lit(False)), F.lit(name))
    return out


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows, by the order of a seeded hash."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def pending(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be done: what a resumed run takes up."""
    return all_rows.join(done.select(key), key, "left_anti")


def count_between(df: DataFrame, low: int, high: int) -> tuple[int, bool]:
    """Number of rows, and whether it is within the range that is expected."""
    n = df.count()
    return n, low <= n <= high


def described(source: Column, statute: Column, section: Column, case: Column, text: Column, width: int = 150) -> Column:
    """A one-line label by source, and the beginning of the text."""
    label = F.when(source == "statute", F.concat_ws(" ", statute, F.concat(F.lit("Section "), section))).otherwise(case)
    return F.concat_ws(": ", label, F.substring(text, 1, width))
