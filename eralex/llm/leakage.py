"""Evaluation texts leaking into training text, by suffix arrays over training shards.

Each shard of training text becomes one array of word numbers, and its suffix array is built by
prefix doubling: suffixes are ranked by their first word, then by pairs of ranks, until whole suffixes are
in order. Every suffix of every test passage is looked up by binary search; the suffixes that share
its first ``n`` words are neighbours in the array, and hits on one diagonal are one longest verbatim match with
its places.

Words are numbered by the vocabulary of the test passages, all others get 0 and end a suffix. A stretch of
fewer than ``n`` known words cannot hold a match and is left out of the array, so sorting
costs little and the result is the same. Shards are the Arrow batches of the
scan: the training text is read once and never shuffled. The test set is the stated query
set; it is broadcast in blocks of ``block_words`` words, which bounds its memory.

Defined results
* words are lower-cased runs of letters and decimal digits;
* null and short texts match nothing; repeated rows are reported each; items with equal
  passages are all reported; an empty test set or table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.llm.words import ALNUM

MATCH = "item_id string, field string, doc_word long, item_word long, n_words long"


class TestSuffixes:
    """The sorted suffixes of a block of test passages."""

    __test__ = False

    def __init__(self, passages: list[tuple[str, str, str]], n: int):
        self.n, self.names, self.vocabulary = n, [], {}
        ids, owner, start = [], [], []
        for item, field, text in passages:
            words = ALNUM.findall(text.lower())
            if len(words) < n:
                continue
            self.names.append((item, field))
            start.append(len(ids))
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            owner += [len(self.names) - 1] * (len(words) + 1)
        self.ids, self.owner, self.start = np.array(ids, np.uint32), np.array(owner, np.int64), np.array(start, np.int64)
        self.places = suffix_array(self.ids, n)
        self.keys, self.first, self.count = np.unique(prefix_keys(self.ids, self.places, n), return_index=True, return_counts=True)

    def matches(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ids, place in the passages, words) of each longest verbatim match."""
        none = (np.zeros(0, np.int64),) * 3
        places = suffix_array(ids, self.n)
        if not len(places) or not len(self.keys):
            return none
        keys = prefix_keys(ids, places, self.n)
        lo, hi = np.searchsorted(keys, self.keys), np.searchsorted(keys, self.keys, "right")
        p, t = [], []
        for j in np.flatnonzero(hi > lo):
            tests = self.places[self.first[j] : self.first[j] + self.count[j]]
            docs = places[lo[j] : hi[j]]
            p.append(np.repeat(docs, len(tests)))
            t.append(np.tile(tests, len(docs)))
        if not p:
            return none
        p, t = np.concatenate(p), np.concatenate(t)
        order = np.lexsort((p, p - t))  # along diagonals
        p, t = p[order], t[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] - t[1:] != p[:-1] - t[:-1]) | (p[1:] != p[:-1] + 1)
        first = np.flatnonzero(new)
        return p[first], t[first], np.diff(np.append(first, len(p))) + self.n - 1


def suffix_array(ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the suffixes of at least n known words, in the order of their words up to the next unknown one."""
    known = np.concatenate(([False], ids != 0, [False]))
    turns = np.flatnonzero(known[1:] != known[:-1])
    start, end = turns[::2], turns[1::2]
    long = end - start >= n
    start, end = start[long], end[long]
    if not len(start):
        return np.zeros(0, np.int64)
    size = end - start
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    places = np.repeat(start, size) + inner
    left = np.repeat(size, size) - inner  # words up to the end of the stretch
    rank = np.zeros(len(ids) + 1, np.int64)
    _, first = np.unique(ids[places], return_inverse=True)
    rank[places] = first + 1
    k, top, most = 1, int(first.max()) + 2, int(size.max())
    while k < most:
        pair = rank[places] * top + np.where(left > k, rank[np.minimum(places + k, len(ids))], 0)
        distinct, both = np.unique(pair, return_inverse=True)
        rank[places] = both + 1
        top = len(distinct) + 1
        if len(distinct) == len(places):
            break
        k *= 2
    order = np.argsort(rank[places], kind="stable")
    return places[order][left[order] >= n]


def prefix_keys(ids: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The first n words of each suffix as bytes that sort like the words."""
    rows = ids[places[:, None] + np.arange(n)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * n}").ravel()


def find_leaks(documents: DataFrame, doc_id: str, text: str, passages: list[tuple[str, str, str]], n: int = 12, block_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, field, doc_word, item_word, n_words): every longest verbatim match of n words or more.

    passages: (item_id, field, text) of the held-out set.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), *T._parse_datatype_string(MATCH).fields])
    blocks, block, words = [], [], 0
    for item, field, t in passages:
        if t is None:
            continue
        size = t.count(" ") + 1
        if block and words + size > block_words:
            blocks.append(block)
            block, words = [], 0
        block.append((item, field, t))
        words += size
    blocks += [block] * bool(block)
    if not blocks:
        return spark.createDataFrame([], schema)

    def search(tests):
        def run(batches):
            index = tests.value
            known = index.vocabulary.get
            for b in batches:
                texts = b.column(1).to_pylist()
                parts, sizes = [], np.zeros(len(texts), np.int64)
                for i, t in enumerate(texts):
                    if t:
                        a = np.fromiter(map(known, ALNUM.findall(t.lower()), itertools.repeat(0)), np.uint32)
                        parts.append(a)
                        sizes[i] = len(a)
                    parts.append(np.zeros(1, np.uint32))
                ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
                p, q, k = index.matches(ids)
                if not len(p):
                    continue
                starts = np.concatenate(([0], np.cumsum(sizes + 1)))
                doc = np.searchsorted(starts, p, "right") - 1
                who = index.owner[q]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(doc)),
                        pa.array([index.names[o][0] for o in who], pa.string()),
                        pa.array([index.names[o][1] for o in who], pa.string()),
                        pa.array(p - starts[doc], pa.int64()),
                        pa.array(q - index.start[who], pa.int64()),
                        pa.array(k, pa.int64()),
                    ],
                    names=schema.names,
                )

        return run

    plain = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = None
    for block in blocks:
        found = plain.mapInArrow(search(spark.sparkContext.broadcast(TestSuffixes(block, n))), schema)
        out = found if out is None else out.unionByName(found)
    return out


def passages_of(items: DataFrame, item_id: str, fields: list[str]) -> list[tuple[str, str, str]]:
    """The stated query set; it is held by the driver, as it is what every shard is asked."""
    out = []
    for r in items.select(item_id, *fields).toLocalIterator():
        out += [(r[0], f, r[i + 1]) for i, f in enumerate(fields) if r[i + 1]]
    return out


def leaked_pairs(documents: DataFrame, doc_id: str, text: str, passages: list[tuple[str, str, str]], n: int = 12) -> DataFrame:
    return find_leaks(documents, doc_id, text, passages, n).select("doc_id", "item_id").distinct()


def without_leaks(documents: DataFrame, doc_id: str, text: str, passages: list[tuple[str, str, str]], n: int = 12) -> DataFrame:
    """Documents that contain no passage of the test set."""
    gone = find_leaks(documents, doc_id, text, passages, n).select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, documents[doc_id] == gone["__gone"], "left_anti")
