"""Best representative of each duplicate group: Bayesian fusion with copy detection.

Every source has an accuracy and, towards every other source, a probability of copying. Both
are estimated in turns with the probability of each claimed value: a value's vote is the
sum over its sources of ln(n A / (1 - A)), where a source that may have copied from a
more accurate one of the same value votes by the rest; values of one item compete by
softmax; an accuracy is the mean probability of the source's claims; and shared false values
speak for copying more than shared true ones. The survivor takes the value of maximum
posterior field by field. The record it stands on, and with it the date, follows a fixed order
(latest date, most fields, latest scrape, smallest id), held against the fused group at the end.

What depends on the data's size is aggregated in the JVM with map-side combine. Values claimed
by the same sources have the same vote, so a group, even one with a third of all rows, shrinks
to one row per field and set of sources. Posteriors depend only on an item's sets of sources: the
estimation runs over a table of distinct patterns of sets with their counts. One number per
source and per pair of sources that meet in an item goes to the driver, for any number of sources.

Defined results
* keys are upper case without anything but A-Z and 0-9; a null or empty key belongs to
  no group; a group of one row stands as it is;
* null and blank values claim nothing; a field without a claim is null in the survivor;
* a value is shown as in its latest row; ties in posterior fall to the value with more
  records, then to the greater value;
* a null source counts as one source of its own; repeated rows are members each;
* an empty table gives an empty result; columns not named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.runtime import cut, if_small

#: Number of wrong values an item may have, prior of copying, share copied by a copier.
N_FALSE, ALPHA, COPIED = 10, 0.2, 0.8
_S, _C, _M = "\x1f", "\x1e", "\x1d"  # between sources of a set, between sets of a pattern, before a number of values


def group_key(c: str) -> Column:
    return F.nullif(F.regexp_replace(F.upper(c), "[^A-Z0-9]", ""), F.lit(""))


def valid_date(c: str, seen: str) -> Column:
    """ISO prefix, else the whole as dd-MM-yyyy; null after the UTC day of ``seen``."""
    # only what has the form is parsed: a failing parse costs as much as hundreds of rows
    iso = F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    parsed = F.coalesce(iso, F.when(F.col(c).rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(c, "dd-MM-yyyy")))
    day = F.to_date(F.to_utc_timestamp(seen, F.current_timezone()))
    return F.when(parsed > day, None).otherwise(parsed)


_BLANK = " \t\n\x0b\f\r"


def filled(c: str | Column) -> Column:
    """Neither null nor blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.length(F.trim(c.cast("string"), F.lit(_BLANK))) > 0, F.lit(False))


def standing(df: DataFrame, key: Column, row_id: str, date: str, seen: str, complete: list[str]) -> DataFrame:
    """(key, group_rec_id, best_rec_id, best_date, n_records) by latest date, most fields, latest scrape, smallest id."""
    rank = F.struct(valid_date(date, seen).alias("d"), sum(filled(c).cast("int") for c in complete).alias("n"), F.col(seen).alias("seen"), (-F.col(row_id)).alias("neg"), F.col(date).cast("string").alias("raw"))
    rows = df.select(key.alias("key"), F.col(row_id).alias("id"), rank.alias("rank")).where("key is not null")
    return rows.groupBy("key").agg(F.min("id").alias("group_rec_id"), F.max("rank").alias("rank"), F.count("*").alias("n_records")).select(
        "key", "group_rec_id", (-F.col("rank.neg")).alias("best_rec_id"), F.when(F.col("rank.d").isNotNull(), F.col("rank.raw")).alias("best_date"), "n_records"
    )


def _members(df: DataFrame, key: Column, source: str, seen: str, fields: dict[str, Column]) -> DataFrame:
    """The columns that claims need, unchanged, so that rows without a group leave before values are compared."""
    used = [c for c in df.columns if c in {*fields, source, seen}]
    return df.select(key.alias("__key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__source"), *used).where("__key is not null")


def grouped(df: DataFrame, groups: DataFrame, key: Column, source: str, seen: str, fields: dict[str, Column]) -> DataFrame:
    """Groups of several rows with their items.

    items: (field, sources, n_values, n, shown) per field and set of sources that claim the
    same values; n and shown are of its value with the most records.
    fields: name -> expression of the comparable form.
    """
    several = groups.where("n_records > 1")
    # joined by a hash: rows laid out by the key itself would be aggregated where they lie, a hot group in one task
    keys = if_small(cut(several.select(F.xxhash64("key").alias("__h")), "several"))
    rows = _members(df, key, source, seen, fields).withColumn("__h", F.xxhash64("__key")).join(keys, "__h", "left_semi")
    each = F.array(*[F.struct(F.lit(i).alias("f"), v.cast("string").alias("value"), F.col(f).cast("string").alias("raw")) for i, (f, v) in enumerate(fields.items())])
    claim = rows.select(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col(seen).alias("seen"), each.alias("each")).select("key", "source", "seen", F.explode("each").alias("x")).where(filled(F.col("x.value")))
    values = claim.groupBy("key", "x.f", F.xxhash64("x.value").alias("value")).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count("*").alias("n"), F.max(F.struct("seen", "x.raw")).alias("shown"))
    alike = values.groupBy("key", "f", "sources").agg(F.count("*").alias("n_values"), F.max(F.struct("n", F.col("shown.raw").alias("raw"))).alias("best"))
    names = F.array(*[F.lit(f) for f in fields])
    item = F.struct(F.get(names, "f").alias("field"), F.array_join("sources", _S).alias("sources"), "n_values", F.col("best.n").alias("n"), F.col("best.raw").alias("shown"))
    return several.join(alike.groupBy("key").agg(F.collect_list(item).alias("items")), "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<field:string,sources:string,n_values:bigint,n:bigint,shown:string>>")))


def alone(df: DataFrame, groups: DataFrame, key: Column, source: str, date: str, seen: str, fields: dict[str, Column], accuracy: dict[str, float]) -> DataFrame:
    """Groups of one row as they stand; every value has the probability of a lone claim of its source."""
    spark = df.sparkSession
    lone = lambda a: round(posteriors(pattern_of([("", 1)]), {"": a}, {})[0][2], 6)
    trust = spark.createDataFrame([(x, lone(a)) for x, a in accuracy.items()], "__source string, __p double")
    one = if_small(cut(groups.where("n_records = 1").select(F.col("key").alias("__key"), "group_rec_id", "best_rec_id", "best_date", "n_records"), "alone"))
    rows = _members(df, key, source, seen, fields).join(one, "__key").join(trust, "__source", "left")
    shown = {f: F.col("best_date") if f == date else F.when(filled(f), F.col(f).cast("string")) for f in fields}
    claimed = F.coalesce(*[v for f, v in shown.items() if f != date], F.lit(None).cast("string")).isNotNull()
    return rows.select(F.col("__key").alias("key"), "group_rec_id", "best_rec_id", "n_records", *[v.alias(f) for f, v in shown.items()], F.when(claimed, F.coalesce("__p", F.lit(lone(0.8)))).alias("min_posterior"))


def pattern_of(sets: list[tuple[str, int]]) -> str:
    """The sets of sources of one item with their numbers of values, in order."""
    return _C.join(f"{s}{_M}{m}" for s, m in sorted(sets))


def patterns(groups: DataFrame) -> DataFrame:
    """(pattern, n): how many items of groups with several rows have which sets of sources."""

    def run(batches):
        for batch in batches:
            seen: Counter = Counter()
            for items in batch.column(0).to_pylist():
                by = defaultdict(list)
                for x in items:
                    by[x["field"]].append((x["sources"], x["n_values"]))
                seen.update(pattern_of(v) for v in by.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    return groups.select("items").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def copy_probability(kt: float, kf: float, kd: float, a: float, b: float) -> float:
    """Posterior that two sources of accuracies a and b are dependent."""
    p = math.sqrt(a * b)
    t, f = p * p, (1 - p) ** 2 / N_FALSE
    d = max(1e-9, 1 - t - f)
    odds = math.log((1 - ALPHA) / ALPHA)
    odds += kt * math.log(t / (p * COPIED + t * (1 - COPIED))) + kf * math.log(f / ((1 - p) * COPIED + f * (1 - COPIED))) + kd * math.log(1 / (1 - COPIED))
    return 1 / (1 + math.exp(min(700, max(-700, odds))))


def vote(sources: str, accuracy: dict[str, float], dependent: dict[tuple[str, str], float]) -> float:
    """Vote of a value, copied shares discounted, in falling order of accuracy."""
    total, before = 0.0, []
    for s in sorted(sources.split(_S), key=lambda s: (-accuracy[s], s)):
        share = 1.0
        for o in before:
            share *= 1 - COPIED * dependent.get((min(s, o), max(s, o)), 0.0)
        total += share * math.log(N_FALSE * accuracy[s] / (1 - accuracy[s]))
        before.append(s)
    return total


def posteriors(pattern: str, accuracy: dict[str, float], dependent: dict[tuple[str, str], float]) -> list[tuple[str, int, float]]:
    """(set of sources, number of values, probability of each such value) of an item."""
    sets = [(s, int(m)) for s, m in (x.rsplit(_M, 1) for x in pattern.split(_C))]
    votes = [vote(s, accuracy, dependent) for s, _ in sets]
    top = max(0.0, *votes)
    whole = sum(m * math.exp(v - top) for v, (_, m) in zip(votes, sets)) + N_FALSE * math.exp(-top)
    return [(s, m, math.exp(v - top) / whole) for v, (s, m) in zip(votes, sets)]


def _tally(pats: DataFrame, accuracy: dict[str, float] | None, dependent: dict[tuple[str, str], float]) -> list:
    """(a, b, true, false, common) of each pair of sources, with b = a the claims of one source.

    Without accuracies every shared value counts as true.
    """

    def run(batches):
        for pdf in batches:
            t: Counter = Counter()
            f: Counter = Counter()
            both: Counter = Counter()
            for pattern, n in zip(pdf["pattern"], pdf["n"]):
                if accuracy is None:
                    post = [(s, int(m), 1.0) for s, m in (x.rsplit(_M, 1) for x in pattern.split(_C))]
                else:
                    post = posteriors(pattern, accuracy, dependent)
                present = set()
                for s, m, p in post:
                    names = s.split(_S)
                    present.update(names)
                    for i, a in enumerate(names):
                        for b in names[i:]:
                            k = (min(a, b), max(a, b))
                            t[k] += n * m * p
                            f[k] += n * m * (1 - p)
                for a in present:
                    for b in present:
                        if a < b:
                            both[(a, b)] += n
            keys = list(t.keys() | both.keys())
            yield pd.DataFrame({"a": [k[0] for k in keys], "b": [k[1] for k in keys], "t": [float(t[k]) for k in keys], "f": [float(f[k]) for k in keys], "c": [float(both[k]) for k in keys]})

    return pats.mapInPandas(run, "a string, b string, t double, f double, c double").groupBy("a", "b").agg(F.sum("t").alias("t"), F.sum("f").alias("f"), F.sum("c").alias("c")).collect()


def estimate(pats: DataFrame, rounds: int = 3) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
    """Accuracies and dependences of the sources. pats: a written table of patterns."""
    rows = _tally(pats, None, {})
    accuracy = {r.a: 0.8 for r in rows if r.a == r.b}
    # before anything is known of accuracies, agreement alone tells copies
    dependent = {(r.a, r.b): copy_probability(r.t, 0, max(0.0, r.c - r.t), 0.8, 0.8) for r in rows if r.a != r.b}
    for _ in range(rounds):
        rows = _tally(pats, accuracy, dependent)
        accuracy = {r.a: min(0.99, max(0.01, r.t / (r.t + r.f))) for r in rows if r.a == r.b}
        dependent = {(r.a, r.b): copy_probability(r.t, r.f, max(0.0, r.c - r.t - r.f), accuracy[r.a], accuracy[r.b]) for r in rows if r.a != r.b}
    return accuracy, dependent


def fuse(df: DataFrame, key_column: str, row_id: str, source: str, date: str, seen: str, complete: list[str], fields: dict[str, Column], rounds: int = 3, single: bool = True) -> DataFrame:
    """One row per group: (key, group_rec_id, best_rec_id, n_records, the fields, min_posterior).

    The date is that of the named record; min_posterior is over the other fields. single: also groups of one row.
    """
    key = group_key(key_column)
    first = cut(standing(df, key, row_id, date, seen, complete), "standing")
    groups = cut(grouped(df, first, key, source, seen, fields), "groups")
    accuracy, dependent = estimate(cut(patterns(groups), "patterns"), rounds)
    names = list(fields)
    kind = df.schema[row_id].dataType.simpleString()
    schema = T._parse_datatype_string(f"key string, group_rec_id {kind}, best_rec_id {kind}, n_records long, {', '.join(f'`{f}` string' for f in names)}, min_posterior double")

    def run(batches):
        scored = lru_cache(maxsize=100_000)(lambda p: {x: q for x, _, q in posteriors(p, accuracy, dependent)})
        for batch in batches:
            out: dict[str, list] = {f: [] for f in names}
            least = []
            items = batch.column("items")
            flat = [items.values.field(i).to_pylist() for i in range(5)]
            offsets = items.offsets.to_pylist()
            for k, best in enumerate(batch.column("best_date").to_pylist()):
                by = defaultdict(list)
                for i in range(offsets[k], offsets[k + 1]):
                    by[flat[0][i]].append(i)
                low = None
                for f in names:
                    if f == date:
                        out[f].append(best)
                    elif claims := by.get(f):
                        post = scored(pattern_of([(flat[1][i], flat[2][i]) for i in claims]))
                        p, _, shown = max((post[flat[1][i]], flat[3][i], flat[4][i]) for i in claims)
                        out[f].append(shown)
                        low = p if low is None else min(low, p)
                    else:
                        out[f].append(None)
                least.append(None if low is None else round(low, 6))
            given = [batch.column(c) for c in ("key", "group_rec_id", "best_rec_id", "n_records")]
            yield pa.RecordBatch.from_arrays([*given, *[pa.array(out[f], pa.string()) for f in names], pa.array(least, pa.float64())], names=schema.names)

    fused = groups.mapInArrow(run, schema)
    return fused.unionByName(alone(df, first, key, source, date, seen, fields, accuracy)) if single else fused
