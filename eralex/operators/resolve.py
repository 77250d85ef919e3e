"""Resolving cited case names to judgments: exact first, then a unique containment."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eralex.functions.text import normal_name
from eralex.runtime import cut, if_small

#: Characters of a gram, grams of a window, and places of the table of frequencies.
GRAM, WINDOW, PLACES = 5, 12, 1 << 16


def _grams(c: Column) -> Column:
    n = F.length(c)
    return F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))


def _place(g: Column) -> Column:
    return F.pmod(F.xxhash64(g), F.lit(PLACES)).cast("int")


def _frequencies(*sides: DataFrame) -> bytes:
    """One printable byte for each place: how often its grams occur in all names, by thirds of a power of two."""
    held = reduce(DataFrame.unionAll, [side.select(F.explode(_grams(F.col("name"))).alias("g")) for side in sides])
    levels = bytearray(b" " * PLACES)
    for place, n in held.groupBy(_place(F.col("g")).alias("place")).agg(F.count("*").alias("n")).collect():
        levels[place] += min(94, int(3 * math.log2(n + 1)))
    return bytes(levels)


def _ranked(c: Column, levels: bytes) -> Column:
    """The grams, each behind its frequency: the least is among the rarest."""
    return F.transform(_grams(c), lambda g: F.concat(F.substring(F.lit(levels), _place(g) + 1, F.lit(1)).cast("string"), g))


def _least(r: Column) -> Column:
    """The least gram of every window; none where a name is shorter than a window."""
    n = F.size(r) - WINDOW + 1
    return F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_min(F.slice(r, i, F.lit(WINDOW)))))).otherwise(F.array().cast("array<string>"))


def _marked(side: DataFrame, levels: bytes) -> DataFrame:
    """Names with their needle g, the least gram of all, and their hay, the least gram of every window."""
    marks = F.transform(F.array(_ranked(F.col("name"), levels)), lambda r: F.struct(F.array_min(r).alias("g"), _least(r).alias("hay")))  # ranked once a name
    return side.where(F.length("name") >= GRAM).withColumn("m", F.get(marks, F.lit(0))).select(*side.columns, "m.g", "m.hay")


def _within(inner: DataFrame, outer: DataFrame, levels: bytes) -> DataFrame:
    """Pairs of a year in which a name of ``inner`` stands in a name of ``outer``; both are marked.

    Exploded sides are many times what the planner takes from their files, so they are never
    broadcast; needles are, where their checked number is small.
    """
    needles = lambda side: side.drop("hay").withColumnRenamed("name", "needle")
    hay = lambda grams: outer.withColumn("g", F.explode(grams)).drop("hay").hint("merge")
    pairs = needles(if_small(inner).where(F.size("hay") > 0)).join(hay(F.col("hay")), ["year", "g"])
    short = cut(inner.where(F.size("hay") == 0), "short")  # shorter than a window: any gram of a name may be the one
    if not short.isEmpty():
        pairs = pairs.unionByName(needles(if_small(short)).join(hay(F.array_distinct(_ranked(F.col("name"), levels))), ["year", "g"]))
    return pairs.where(F.col("name").contains(F.col("needle")))


def name_index(judgments: DataFrame) -> DataFrame:
    """(name, year, jid): the last judgment of a name and year; "(review)" is no part of a name."""
    name = F.trim(F.replace(normal_name("case_name"), F.lit("(review)"), F.lit("")))
    keyed = judgments.where("case_name is not null and date is not null").select(name.alias("name"), F.year("date").cast("string").alias("year"), "judgment_id", "ingested_at")
    return keyed.groupBy("name", "year").agg(F.max_by("judgment_id", F.struct("ingested_at", "judgment_id")).alias("jid"))


def resolve(names: DataFrame, index: DataFrame) -> DataFrame:
    """names: (name, year), distinct -> (name, year, jid, tier); jid is null where no or several judgments fit.

    If one name contains the other, it contains every window of grams of the shorter, and so the least gram of each.
    Grams are ordered by how often they occur, so "State of" brings nobody together. Each name
    offers its least gram as a needle and the least of every window as hay, and pairs meet on (year, gram).
    Names are marked row by row: the frequencies are one short string, with places shared by hash; that the order is rough costs pairs, never a match.
    """
    index = cut(index, "known")  # read several times, as are the next three
    named = cut(names.hint("merge").join(if_small(index).withColumn("tier", F.lit(1)), ["name", "year"], "left"), "names")
    rest = named.where("tier is null").select("name", "year")
    levels = _frequencies(rest, index)
    a, b = cut(_marked(rest, levels), "marked-names"), cut(_marked(index, levels), "marked-known")
    in_known = _within(a, b, levels).select(F.col("needle").alias("name"), "year", "jid")
    in_name = _within(b, a, levels).select("name", "year", "jid")
    fits = in_known.unionByName(in_name).groupBy("name", "year").agg(F.countDistinct("jid").alias("n"), F.min("jid").alias("fit"))
    found = named.join(fits.where("n = 1").drop("n"), ["name", "year"], "left")
    return found.select("name", "year", F.coalesce("jid", "fit").alias("jid"), F.coalesce("tier", F.when(F.col("fit").isNotNull(), 2).otherwise(0)).alias("tier"))
