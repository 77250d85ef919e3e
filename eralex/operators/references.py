"""References to records that do not exist, by signed counts over change deltas.

Existence is a stream of +1 / -1 changes per key, references a stream of +1 per key.
The running existence count of a key, taken over its changes alone, gives the lifetimes in which
it exists. A reference is an orphan when its moment lies in no lifetime of its key; a key is a
current orphan when its reference count is positive and its existence count zero after all
changes.

A key may be hot (a landmark record takes a large share of all references): references are
never windowed or sorted into one group. They meet the lifetimes of their key in one join, whose
large side the engine splits when a key is skewed; overlapping records of a key merge into one
lifetime, so a reference meets as many rows as its record has separate lives. Changes are
first summed per (key, moment) with map-side combine, then prefix sums are taken on two
levels: over the days of a key (as many rows as the calendar has days) and within a day.

Defined results
* keys are trimmed and upper-cased; a null or empty key is no reference;
* an existence row without a start, or ended at or before its start, never exists;
* a reference without a moment is an orphan, since nothing is known to exist then;
* a reference at the very moment of a start finds the record, at the moment of an
  end it does not;
* repeated rows each count; empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_of(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def month_of(c: str | Column) -> Column:
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM")


def existence_deltas(records: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """(key, ts, d): +1 where a record starts to exist, -1 where it ends."""
    real = records.select(key_of(key).alias("key"), F.col(since).alias("s"), F.col(until).alias("u")).where(
        "key is not null and s is not null and (u is null or u > s)"
    )
    return real.select("key", F.explode(F.array(F.struct(F.col("s").alias("ts"), F.lit(1).alias("d")), F.struct(F.col("u").alias("ts"), F.lit(-1).alias("d")))).alias("x")).select(
        "key", "x.ts", F.col("x.d").cast("long").alias("d")
    ).where("ts is not null")


def references(rows: DataFrame, row_id: str, columns: list[str], at: str) -> DataFrame:
    """(row_id, ref_column, key, ts): one row per non-empty reference."""
    each = F.array(*[F.struct(F.lit(c).alias("ref_column"), key_of(c).alias("key")) for c in columns])
    return (
        rows.select(F.col(row_id).alias("row_id"), F.col(at).alias("ts"), F.explode(each).alias("x"))
        .select("row_id", "x.ref_column", "x.key", "ts")
        .where("key is not null")
    )


def lifetimes(deltas: DataFrame) -> DataFrame:
    """(key, since, until): the longest stretches in which a key exists; they do not overlap, until is null while it lasts."""
    moments = deltas.groupBy("key", "ts").agg(F.sum("d").alias("d")).where("d <> 0").withColumn("day", F.date_trunc("day", "ts"))
    before = F.sum("net").over(W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1))
    opening = moments.groupBy("key", "day").agg(F.sum("d").alias("net")).select("key", "day", F.coalesce(before, F.lit(0)).alias("opening"))
    within = F.sum("d").over(W.partitionBy("key", "day").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    counted = moments.withColumn("within", within).join(opening, ["key", "day"]).withColumn("n", F.col("within") + F.col("opening"))
    turns = counted.where((F.col("n") > 0) != (F.col("n") - F.col("d") > 0))
    return turns.select("key", F.col("ts").alias("since"), F.lead("ts").over(W.partitionBy("key").orderBy("ts")).alias("until"), "n").where("n > 0").drop("n")


def _alive() -> Column:
    return (F.col("r.key") == F.col("l.key")) & (F.col("l.since") <= F.col("r.ts")) & (F.col("l.until").isNull() | (F.col("l.until") > F.col("r.ts")))


def orphan_references(rows: DataFrame, row_id: str, columns: list[str], at: str, records: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """(row_id, ref_column, key, ts) of every reference to a record missing at its moment."""
    refs, lives = references(rows, row_id, columns, at), lifetimes(existence_deltas(records, key, since, until))
    return refs.alias("r").join(lives.alias("l"), _alive(), "left_anti")


def orphan_report(table_name: str, rows: DataFrame, columns: list[str], at: str, records: DataFrame, key: str, since: str, until: str) -> DataFrame:
    """Per table, reference column and month: references, orphans and orphan keys."""
    refs, lives = references(rows.withColumn("__row", F.lit(0)), "__row", columns, at), lifetimes(existence_deltas(records, key, since, until))
    marked = refs.alias("r").join(lives.alias("l"), _alive(), "left").select("r.ref_column", month_of("r.ts").alias("month"), F.col("r.key").alias("key"), F.col("l.since").isNull().alias("lost"))
    return (
        marked.groupBy("ref_column", "month", "key")
        .agg(F.count("*").alias("n"), F.count(F.when(F.col("lost"), 1)).alias("o"))
        .groupBy("ref_column", "month")
        .agg(F.sum("n").alias("n_references"), F.sum("o").alias("n_orphans"), F.count(F.when(F.col("o") > 0, 1)).alias("n_orphan_keys"))
        .select(F.lit(table_name).alias("table_name"), "ref_column", "month", "n_references", "n_orphans", "n_orphan_keys")
    )


def signed_state(deltas: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, existence, refs): the signed counts after a batch of changes."""
    return (
        deltas.select("key", F.col("d").alias("existence"), F.lit(0).cast("long").alias("refs"))
        .unionByName(refs.select("key", F.lit(0).cast("long").alias("existence"), F.lit(1).cast("long").alias("refs")))
        .groupBy("key")
        .agg(F.sum("existence").alias("existence"), F.sum("refs").alias("refs"))
    )


def merge_state(state: DataFrame, change: DataFrame) -> DataFrame:
    """Add the counts of a later batch; keys that cancel out to nothing are let go."""
    return (
        state.unionByName(change).groupBy("key").agg(F.sum("existence").alias("existence"), F.sum("refs").alias("refs")).where("existence <> 0 or refs <> 0")
    )


def current_orphans(state: DataFrame) -> DataFrame:
    return state.where("refs > 0 and existence <= 0").select("key", "refs")
