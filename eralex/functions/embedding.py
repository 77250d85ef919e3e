"""Signed hashing of words into vectors, and blocked exact similarity search."""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.runtime import cut

DIM = 256
_WORD = re.compile("[a-z0-9]+")


class Hasher:
    """index = h mod dim and sign by the next bit, h = sha256 of the word; kept per worker."""

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        for w in words:
            if w not in self.known:
                h = int(hashlib.sha256(w.encode()).hexdigest(), 16)
                self.known[w] = h % self.dim + self.dim * ((h // self.dim) % 2)

    def vector(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        try:
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn(words)
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = np.bincount(at, minlength=2 * self.dim)
        v = (n[: self.dim] - n[self.dim :]).astype(float)
        size = np.linalg.norm(v)
        return v / size if size else v


def best(sim: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k greatest of each row; ties go to the smaller id, -inf is left out."""
    if sim.shape[1] > 4 * k:  # nothing under the k-th greatest can be among them
        kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1 : k]
        some = np.flatnonzero((sim >= kth).any(0))
        sim, picked = sim[:, some], some
    else:
        picked = np.arange(sim.shape[1])
    by_id = np.argsort(own[picked], kind="stable")
    top = by_id[np.argsort(-sim[:, by_id], axis=1, kind="stable")[:, :k]]
    value = np.take_along_axis(sim, top, 1)
    ok = np.isfinite(value)
    return np.nonzero(ok)[0], picked[top[ok]], value[ok]


class Top:
    """The k best of each query over all batches of a task; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.own = k, np.full((queries, k), -np.inf), None

    def add(self, sim: np.ndarray, own: np.ndarray) -> None:
        """sim: queries by documents; own: ids of the documents."""
        if not len(own):
            return
        own = own.astype(str) if own.dtype == object else own
        if self.own is None:
            self.own = np.zeros(self.score.shape, own.dtype)
        some = np.flatnonzero(sim.max(1) >= self.score[:, -1])  # queries that may gain
        if not len(some):
            return
        row, column, value = best(sim[some], own, self.k)
        within = np.arange(len(row)) - np.searchsorted(row, row)
        score, ids = np.full((len(some), self.k), -np.inf), np.zeros((len(some), self.k), own.dtype)
        score[row, within], ids[row, within] = value, own[column]
        score, ids = np.concatenate([self.score[some], score], 1), np.concatenate([self.own[some], ids], 1)
        order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        if ids.dtype.itemsize > self.own.dtype.itemsize:
            self.own = self.own.astype(ids.dtype)
        self.score[some], self.own[some] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)

    def rows(self) -> tuple[np.ndarray, list, np.ndarray]:
        """(query, id, score) of what is kept."""
        ok = np.isfinite(self.score)
        return np.nonzero(ok)[0], [] if self.own is None else self.own[ok].tolist(), self.score[ok]


ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def vectors(df: DataFrame, keep: list[str], text: str, dim: int = DIM) -> DataFrame:
    """The columns ``keep`` and the unit vector of ``text``."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(batches):
        h = Hasher(dim)
        for b in batches:
            flat = np.concatenate([h.vector(t) for t in b.column(len(keep)).to_pylist()]) if b.num_rows else np.zeros(0)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], arr], names=schema.names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column as rows; a missing vector is zero."""
    flat = column.flatten()
    if not column.null_count and not flat.null_count and len(flat) == dim * len(column):
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == dim).all():
            return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    return np.array([np.asarray(v, float) if v is not None else np.zeros(dim) for v in column.to_pylist()])


def search(docs: DataFrame, doc_id: str, vec: str, queries: DataFrame, query_id: str, query_vec: str, k: int, block: int = 2_000, without_self: bool = False) -> DataFrame:
    """(query_id, doc_id, sim, rank): the k most similar documents of every query, exact.

    The stated queries are multiplied in blocks with each batch of documents; a task keeps its k best
    for each query and sends on only those, so the shuffle carries k rows per query and task.
    Null and zero vectors have similarity 0; a document without an id is left out. Ties go to the smaller id.
    """
    spark = docs.sparkSession
    out_schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("sim", T.DoubleType())])
    asked = queries.select(query_id, query_vec).toLocalIterator()
    found, part = None, list(itertools.islice(asked, block))
    while part:
        dim = max(len(v or ()) for _, v in part)
        q = np.array([np.asarray(v, float) if v is not None else np.zeros(dim) for _, v in part])
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast(([i for i, _ in part], q / np.where(norm == 0, 1, norm)))

        def run(batches, shared=shared):
            ids, q = shared.value
            names = np.array(ids)
            top = Top(len(ids), k)
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column(0).to_numpy(zero_copy_only=False)
                m = _matrix(b.column(1), q.shape[1])
                n = np.linalg.norm(m, axis=1, keepdims=True)
                sim = np.round(q @ (m / np.where(n == 0, 1, n)).T, 6)
                if without_self:
                    sim[names[:, None] == own[None]] = -np.inf
                top.add(sim, own)
            row, found_ids, value = top.rows()
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), out_arrow), pa.array(found_ids, doc_arrow), pa.array(value + 0.0)], names=out_schema.names)

        out_arrow, doc_arrow = (ARROW[x.simpleString()] for x in (queries.schema[query_id].dataType, docs.schema[doc_id].dataType))
        one = docs.where(F.col(doc_id).isNotNull()).select(doc_id, vec).mapInArrow(run, out_schema)
        part = list(itertools.islice(asked, block))
        if part or found is not None:  # of several blocks only one is held at a time
            one = cut(one, "found")
            shared.unpersist()
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], out_schema).withColumn("rank", F.lit(0))
    w = W.partitionBy(query_id).orderBy(F.desc("sim"), doc_id)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
