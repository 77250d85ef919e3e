"""Metrics of ranked results and statistics of their comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODULUS, FACTOR, BLOCK, STRIDE = 2_147_483_647, 48_271, 250, 1 << 20


def parent_of(doc_id: Column) -> Column:
    return F.split_part(doc_id, F.lit("::w"), F.lit(1))


def relevant(doc_id: Column, gold: Column, fixed: Column) -> Column:
    """Whether a result is gold; a fixed-window chunk counts for its parent."""
    return F.array_contains(gold, doc_id) | (fixed & F.array_contains(gold, parent_of(doc_id)))


def ranking(ranked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k. ranked: (query_id, doc, rank); items: (query_id, gold)."""
    rel = ranked.where(F.col("rank") <= k).join(items.select("query_id", F.explode(F.array_distinct("gold")).alias("doc")), ["query_id", "doc"]).groupBy("query_id").agg(
        F.countDistinct("doc").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg")
    )
    n = F.size("gold")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    out = items.join(rel, "query_id", "left").where(n > 0)
    return out.select(
        "query_id", F.round(F.coalesce("hits", F.lit(0)) / n, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg")
    )


def hit_metrics(ranked: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Per configuration and item: hit5, hit10, rr, dcg (ideal 1) and the era of the first result.

    ranked: (by..., query_id, doc, statute, rank, fixed); one pass over the ranked rows.
    """
    r = ranked.where("rank <= 10").join(items.select("query_id", "gold", "era"), "query_id").withColumn("rel", relevant(F.col("doc"), F.col("gold"), F.col("fixed")))
    hit = lambda k: F.max(F.when(F.col("rel") & (F.col("rank") <= k), 1).otherwise(0))
    return r.groupBy(*by, "query_id").agg(
        hit(5).alias("hit5"),
        hit(10).alias("hit10"),
        F.coalesce(1 / F.min(F.when(F.col("rel"), F.col("rank"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.max(F.when((F.col("rank") == 1) & (F.col("era") != ""), (F.col("statute") == F.col("era")).cast("int"))).alias("era_ok"),
    )


def summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """mean, population deviation, n and n_excluded of each column; null is "not applicable"."""
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select(*by, "m.*")
    return long.groupBy(*by, "metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.count("x").alias("n"), F.count(F.when(F.col("x").isNull(), 1)).alias("n_excluded"))


def draw(rep: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Deterministic indices below n for a replicate and its draws, equal in every engine."""
    x = (rep * 1000 + i + 1) * FACTOR % MODULUS
    x = (x * FACTOR + rep) % MODULUS
    return (x * FACTOR + i) % MODULUS % n


def replicates(scores: DataFrame, by: list[str], value: str, reps: int) -> DataFrame:
    """(by..., rep, mean, n, obs): bootstrap means.

    A configuration is the histogram of its scores: distinct values and how often they occur, added up with
    map-side combine, so no list of all scores is ever made. A draw is a place among the scores in their order by
    value. Blocks of replicates are spread over the tasks; a replicate draws in vectors of ``STRIDE``.
    """
    bars = scores.groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    hist = bars.groupBy(*by).agg(F.sum("__c").alias("n"), (F.sum(F.col("__v") * F.col("__c")) / F.sum("__c")).alias("obs"), F.array_sort(F.collect_list(F.struct("__v", "__c"))).alias("__h"))
    flat = hist.select(*by, "n", "obs", F.transform("__h", lambda x: x["__v"]).alias("values"), F.transform("__h", lambda x: x["__c"]).alias("counts"))
    parts = flat.select(*by, "n", "obs", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(BLOCK))).alias("start"), "values", "counts").repartition(4 * scores.sparkSession.sparkContext.defaultParallelism)
    kept = len(by) + 2
    schema = T.StructType([*parts.schema.fields[:kept], T.StructField("rep", T.LongType()), T.StructField("total", T.DoubleType())])

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                start, n = b.column(kept)[row].as_py(), b.column(kept - 2)[row].as_py()
                values = b.column(kept + 1)[row].values.to_numpy(zero_copy_only=False)
                upto = np.cumsum(b.column(kept + 2)[row].values.to_numpy(zero_copy_only=False))
                own = range(start, min(start + BLOCK, reps))
                same, total = pa.array(np.full(len(own), row)), np.zeros(len(own))
                several = max(1, STRIDE // max(1, n))  # replicates at once
                for k in range(0, len(own), several):
                    rep = np.arange(own[k], own[min(k + several, len(own)) - 1] + 1, dtype=np.int64)[:, None]
                    for lo in range(0, n, STRIDE):
                        i = np.arange(lo, min(lo + STRIDE, n), dtype=np.int64)[None]
                        total[k : k + several] += values[np.searchsorted(upto, draw(rep, i, n), "right")].sum(1)
                yield pa.RecordBatch.from_arrays([*[c.take(same) for c in b.columns[:kept]], pa.array(own, pa.int64()), pa.array(total, from_pandas=True)], names=schema.names)

    return parts.mapInArrow(run, schema).select(*by, "rep", F.round(F.col("total") / F.col("n"), 9).alias("mean"), "n", "obs")


def bootstrap_ci(scores: DataFrame, by: list[str], value: str, reps: int, level: float = 0.95) -> DataFrame:
    low, high = int((1 - level) / 2 * reps), int((1 - (1 - level) / 2) * reps) - 1
    r = replicates(scores, by, value, reps).withColumn("k", F.row_number().over(W.partitionBy(*by).orderBy("mean", "rep")) - 1)
    return r.groupBy(*by).agg(F.round(F.max("obs"), 6).alias("mean"), F.round(F.max(F.when(F.col("k") == low, F.col("mean"))), 6).alias("low"), F.round(F.max(F.when(F.col("k") == high, F.col("mean"))), 6).alias("high"), F.max("n").alias("n"))


def paired_differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, diff) of two configurations scored on the same items; items that only one of them has are an error."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b"), F.lit(True).alias("there")), key, "full")
    out = both.select(key, (F.col("a") - F.col("b")).alias("diff"))
    if not both.where("there is null or a is null").isEmpty():
        raise ValueError("the two configurations were not scored on the same items")
    return out


def paired_bootstrap(diffs: DataFrame, by: list[str], value: str, reps: int) -> DataFrame:
    """(by..., diff, p): share of replicates at least as far from the observed difference as that is from 0."""
    r = replicates(diffs, by, value, reps)
    far = F.abs(F.col("mean") - F.col("obs")) >= F.abs("obs") - 1e-12
    return r.groupBy(*by).agg(F.round(F.max("obs"), 6).alias("diff"), F.round(F.avg(far.cast("double")), 6).alias("p"))


def holm(tests: DataFrame, name: str, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-down: a test is significant if it and all with smaller p stay under alpha / (m - i). A family of tests is small."""
    w = W.orderBy(p, name)
    t = tests.withColumn("i", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(W.partitionBy()))
    t = t.withColumn("threshold", F.lit(alpha) / (F.col("m") - F.col("i"))).withColumn("pass", (F.col(p) <= F.col("threshold")).cast("int"))
    return t.withColumn("significant", F.min("pass").over(w.rowsBetween(W.unboundedPreceding, 0)) == 1).select(name, p, F.round("threshold", 6).alias("threshold"), "significant")
