"""BM25: term statistics by aggregation, scores of a stated query set in blocks."""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.functions.embedding import ARROW, Top
from eralex.functions.text import STOPWORDS, tokens
from eralex.runtime import cut

K1, B, EPSILON, POOL = 1.5, 0.75, 0.25, 50
_WORD = re.compile("[a-z0-9]+")


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf, dl): one row per document and term."""
    tok = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.coalesce(text, F.lit(""))).alias("t"))
    return tok.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def corpus_size(docs: DataFrame, text: str) -> tuple[int, float]:
    """Documents and mean length in tokens, in one scan without a shuffle of the texts."""
    r = docs.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.coalesce(text, F.lit(""))))).alias("a")).head()
    return r.n, r.a or 0.0


def term_stats(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf); a negative idf becomes EPSILON times the mean idf of all terms."""
    df = post.groupBy("term").agg(F.count("*").alias("df")).withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw")).scalar()
    return df.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def _document_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, df, dl) of each batch: documents that hold a term; under the empty term all documents and their tokens."""
    stop = frozenset(STOPWORDS)

    def run(batches):
        for b in batches:
            df: Counter = Counter()
            dl = 0
            for t in b.column(0).to_pylist():
                n = Counter(_WORD.findall((t or "").lower()))
                own = n.keys() - stop
                df.update(own)
                dl += sum(n.values()) - sum(n[w] for w in n.keys() & stop)
            yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([b.num_rows, *df.values()], pa.int64()), pa.array([dl] + [0] * len(df), pa.int64())], names=["term", "df", "dl"])

    return docs.select(text).mapInArrow(run, "term string, df long, dl long")


def query_weights(docs: DataFrame, text: str, queries: DataFrame, query_id: str, question: str) -> tuple[list, dict[str, int], np.ndarray, float]:
    """(query ids, terms, weights of terms by queries, mean length): what a task needs to score any document.

    One scan of the documents: the empty term, which no token is, stands for the document itself.
    """
    asked = [(r[0], Counter(r[1] or ())) for r in queries.select(query_id, tokens(question)).toLocalIterator()]
    terms = {t: i for i, t in enumerate(sorted({t for _, c in asked for t in c}))}
    stats = cut(_document_counts(docs, text).groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")), "terms")
    whole = stats.where("term = ''").head()
    n, avgdl = (whole.df, whole.dl / whole.df) if whole and whole.df else (0, 0.0)
    raw = stats.where("term <> ''").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    listed = docs.sparkSession.createDataFrame([(t,) for t in terms], "term string").withColumn("asked", F.lit(True))
    r = raw.join(listed, "term", "left").agg(F.avg("raw").alias("mean"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw"))).alias("own")).head()
    weights = np.zeros((len(terms), len(asked)))
    idf = {x.term: x.raw if x.raw >= 0 else EPSILON * r.mean for x in r.own}
    for q, (_, c) in enumerate(asked):
        for t, k in c.items():
            weights[terms[t], q] = k * idf.get(t, 0.0)
    return [q for q, _ in asked], terms, weights, avgdl


def bm25(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, question: str, size: int = POOL, block: int = 2_000) -> DataFrame:
    """(query_id, doc_id, score, rank): the best of all documents, those of score 0 included; a document without an id is left out.

    The stated queries are scored in blocks, each with the weights of its own terms only. Term frequencies of
    a slice of documents, over the terms that the slice holds, times those weights is one matrix product.
    A task keeps its ``size`` best for each query and sends on only those, so no posting is ever shuffled.
    """
    spark = docs.sparkSession
    out_schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())])
    docs = docs.where(F.col(doc_id).isNotNull())
    names, terms, weights, avgdl = query_weights(docs, text, queries, query_id, question)
    kinds = [ARROW[x.dataType.simpleString()] for x in out_schema.fields[:2]]
    stop, listed = frozenset(STOPWORDS), list(terms)
    found = None
    for at in range(0, len(names), block):
        own = weights[:, at : at + block]
        used = np.flatnonzero(own.any(1))
        shared = spark.sparkContext.broadcast((names[at : at + block], {listed[t]: k for k, t in enumerate(used)}, own[used]))

        def run(batches, shared=shared):
            ids, terms, w = shared.value
            v = len(terms)
            number = {**terms, **dict.fromkeys(stop - terms.keys(), v + 1)}.get
            top = Top(len(ids), size)
            for whole in batches:
                for lo in range(0, whole.num_rows, 1_000):
                    b = whole.slice(lo, 1_000)
                    parts = [np.fromiter(map(number, _WORD.findall((t or "").lower()), repeat(v)), np.int64) for t in b.column(1).to_pylist()]
                    of, term = np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts)
                    dl = np.bincount(of[term <= v], minlength=len(parts)).astype(float)  # stop words have no length
                    of, term = of[term < v], term[term < v]
                    here, column = np.unique(term, return_inverse=True)
                    tf = np.bincount(of * len(here) + column, minlength=len(parts) * len(here)).reshape(len(parts), len(here)).astype(float)
                    norm = K1 * (1 - B + B * dl[:, None] / (avgdl or 1.0))
                    top.add(np.round(w[here].T @ (tf * (K1 + 1) / (tf + norm)).T, 6) + 0.0, b.column(0).to_numpy(zero_copy_only=False))
            row, own, value = top.rows()
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in row], kinds[0]), pa.array(own, kinds[1]), pa.array(value)], names=out_schema.names)

        one = docs.select(doc_id, text).mapInArrow(run, out_schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], out_schema)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)
