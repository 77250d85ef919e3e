"""Abusive, hateful or sexual content: FTRL-proximal logistic regression.

Texts are cut into passages (sentences and lines); a passage is its words, brought back from
usual disguises, as hashed n-grams and skip-grams. A document scores as its worst passage.
Words inside quotation marks count as one mark, so reported speech is judged by what
surrounds it. Raters label whole documents, so training alternates between fitting and
choosing which passages of a flagged document carry the flag; passages of unflagged
documents are all negative. Learning rates are per coordinate, and the L1 term leaves few weights,
which are broadcast sparsely (at most 2^20 of them whatever the input).

Fitting uses at most ``LABELLED`` documents of ``CHARS`` characters in all and ``PASSAGES`` passages (by hash order);
scoring covers every document and its whole text in one scan without a shuffle.

Defined results
* a null or empty text scores 0; repeated rows are scored each;
* votes are averaged over raters, null votes are no votes, even splits are not used;
* without labels of both kinds every score is 0;
* passages end at ".", "!", "?", danda and line breaks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED, CHARS, PASSAGES = 8_000, 64_000_000, 40_000
#: Least share of new features in a passage that carries a flag.
NOVEL = 0.4
BITS = 20
TOKEN = re.compile(r"\n|[^\s]+")
LEET = str.maketrans("013457@$!|", "oieastasii")
END, OPEN, CLOSE, SINGLE, EMPTY = 1, 2, 4, 8, 16
QUOTED = 0x51ED270B
_EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$")
_PART = re.compile(r"^\w(?:[.\-_]\w){2,}$")


def plain_word(raw: str) -> str:
    """A word without case, edge punctuation and usual disguises; "" for punctuation."""
    w = unicodedata.normalize("NFKC", raw).lower()
    if any(c.isalpha() for c in w) and any(c in "013457@$!|" for c in w.strip(".,;:!?\"'")):
        t = w.rstrip(".,;:!?\"'”’…").lstrip("\"'“‘(").translate(LEET)
        if t.isalpha() and sum(c.isalpha() for c in w) >= 2:
            w = t
    w = _EDGE.sub("", w)
    if not w:
        return ""
    if _PART.match(w):
        w = re.sub(r"[.\-_]", "", w)
    if "*" in w and len(w) > 2:
        return w[0] + "*" + w[-1]
    w = re.sub(r"(\w)\1{2,}", r"\1", w) if not any(c.isdigit() for c in w) else re.sub(r"\d[\d.,:/\-]*", "0", w)
    return w


class Words:
    """Hash and flags of raw words, kept in bounded numbers."""

    LIMIT = 500_000

    def __init__(self):
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {"\n": 0}
        self.hashes, self.flags = [0], [END | EMPTY]

    def add(self, raw: str) -> int:
        w = plain_word(raw)
        flags = 0 if w else EMPTY
        body = raw.rstrip(".,;:!?)।॥…")
        tail = raw[len(body) :] + raw[-1:]
        if raw[-1] in ".!?।॥…" or (raw[-1] in "\"”’" and raw[-2:-1] in ".!?।॥…" and raw[-2:-1]):
            if not (len(w) <= 3 and raw[-1] == "." and w in ("rs", "no", "mr", "mrs", "dr", "v", "vs", "smt", "art", "sec", "st", "ltd", "co", "crl", "nos")) and not (len(w) == 1 and w.isalpha() and raw[0].isupper()):
                flags |= END
        if raw.lstrip("([")[:1] in ("\"", "“", "‘"):
            flags |= OPEN
        if any(c in tail for c in "\"”") or body[-1:] in ("\"", "”") or (body[-1:] == "’"):
            if len(raw) > 1 or raw == "”":
                flags |= CLOSE
        if len(w) == 1 and w.isalpha():
            flags |= SINGLE
        i = self.known[raw] = len(self.hashes)
        self.hashes.append(zlib.crc32(w.encode()))
        self.flags.append(flags)
        return i

    def ids(self, tokens: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.known.get, tokens, repeat(-1)), np.int64, len(tokens))
        for j in np.flatnonzero(got < 0):
            t = tokens[j]
            got[j] = self.known[t] if t in self.known else self.add(t)
        return got


_SPACED = re.compile(r"(?<!\S)(?:[^\W\d_] ){3,}[^\W\d_](?=[^\w]|$)")


def passages(words: Words, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, passage number of each word, text number of each passage)."""
    if len(words.known) > Words.LIMIT:
        words.clear()
    all_ids, counts = [], []
    for t in texts:
        ids = words.ids(TOKEN.findall(t or ""))
        all_ids.append(ids)
        counts.append(len(ids))
    flags = np.array(words.flags, np.uint8)
    for i, ids in enumerate(all_ids):
        single = (flags[ids] & SINGLE) > 0
        if len(ids) > 3 and (single[:-3] & single[1:-2] & single[2:-1] & single[3:]).any():
            joined = _SPACED.sub(lambda m: m.group().replace(" ", ""), texts[i])
            all_ids[i] = words.ids(TOKEN.findall(joined))
            counts[i] = len(all_ids[i])
    flags, hashes = np.array(words.flags, np.uint8), np.array(words.hashes, np.uint32)
    ids = np.concatenate(all_ids) if all_ids else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    f, h = flags[ids], hashes[ids]
    # inside quotation marks, counted from the start of the line
    line = np.cumsum(np.concatenate(([0], ((ids[:-1] == 0) | (doc[1:] != doc[:-1])).astype(np.int64)))) if len(ids) else ids
    opened, closed = np.cumsum((f & OPEN) > 0), np.cumsum((f & CLOSE) > 0)
    first = np.searchsorted(line, line) if len(ids) else ids
    o = opened - opened[first] + ((f[first] & OPEN) > 0) if len(ids) else ids
    c = closed - closed[first] + ((f[first] & CLOSE) > 0) if len(ids) else ids
    last = np.searchsorted(line, line, "right") - 1 if len(ids) else ids
    balanced = o[last] == c[last] if len(ids) else ids
    inside = (o - c + ((f & CLOSE) > 0) > 0) & balanced if len(ids) else np.zeros(0, bool)
    h = np.where(inside, np.uint32(QUOTED), h)
    end = ((f & END) > 0) & ~(inside & ((f & CLOSE) == 0) & (ids != 0))
    begin = np.ones(len(ids), bool)
    if len(ids):
        begin[1:] = end[:-1] | (doc[1:] != doc[:-1])
    keep = (f & EMPTY) == 0
    keep[1:] &= ~(inside[1:] & inside[:-1])  # a quotation is one mark
    number = np.cumsum(begin) - 1
    number, h, doc = number[keep], h[keep], doc[keep]
    if not len(number):
        return h, number, doc
    new = np.concatenate(([True], number[1:] != number[:-1]))
    return h, np.cumsum(new) - 1, doc[new]


def features(h: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, passage) of every n-gram and skip-gram inside its passage."""
    h = h.astype(np.uint64)
    mask = np.uint64((1 << BITS) - 1)

    def mix(x):
        with np.errstate(over="ignore"):
            x = x * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x = x * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(36)) & mask).astype(np.int64)

    out, of = [mix(h)], [number]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 3), (2, 5), (3, 7)):
            if len(h) > gap:
                same = number[gap:] == number[:-gap]
                out.append(mix(h[:-gap] * np.uint64(31) + h[gap:] * np.uint64(1_000_003) + np.uint64(salt))[same])
                of.append(number[gap:][same])
        if len(h) > 2:
            same = number[2:] == number[:-2]
            out.append(mix(h[:-2] * np.uint64(131) + h[1:-1] * np.uint64(65_599) + h[2:] * np.uint64(16_777_619) + np.uint64(11))[same])
            of.append(number[2:][same])
    return np.concatenate(out), np.concatenate(of)


class Ftrl:
    """FTRL-proximal over hashed features, in batches."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.3, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias_z = self.bias_n = 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + np.sqrt(self.bias_n)) / self.alpha)

    def fit(self, bucket: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = 1024) -> None:
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            length = start[rows + 1] - start[rows]
            row = np.repeat(np.arange(len(rows)), length)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            at = bucket[start[rows][row] + inner]
            scale = 1 / np.sqrt(np.maximum(length, 1))
            used, where = np.unique(at, return_inverse=True)
            w = self.weights(used)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[where], len(rows)) * scale + self.bias(), -30, 30)))
            err = (p - y[rows]) * weight[rows]
            g = np.bincount(where, (err * scale)[row], len(used))
            sigma = (np.sqrt(self.n[used] + g * g) - np.sqrt(self.n[used])) / self.alpha
            self.z[used] += g - sigma * w
            self.n[used] += g * g
            gb = err.sum()
            s = (np.sqrt(self.bias_n + gb * gb) - np.sqrt(self.bias_n)) / self.alpha
            self.bias_z += gb - s * self.bias()
            self.bias_n += gb * gb


class Model:
    """Sparse weights."""

    def __init__(self, index: np.ndarray, value: np.ndarray, bias: float):
        self.index, self.value, self.bias = index, value, bias
        self.words: Words | None = None
        self.full: np.ndarray | None = None

    def __getstate__(self):
        return self.index, self.value, self.bias

    def __setstate__(self, s):
        self.__init__(*s)

    def passage_scores(self, h: np.ndarray, number: np.ndarray) -> np.ndarray:
        if self.full is None:
            self.full = np.zeros(1 << BITS, np.float32)
            self.full[self.index] = self.value
        n = int(number[-1]) + 1 if len(number) else 0
        bucket, of = features(h, number)
        length = np.bincount(of, minlength=n)
        return 1 / (1 + np.exp(-np.clip(np.bincount(of, self.full[bucket], n) / np.sqrt(np.maximum(length, 1)) + self.bias, -30, 30)))

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(worst score, number of passages over one half) of each text."""
        if self.words is None:
            self.words = Words()
        worst, over = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        h, number, doc = passages(self.words, texts)
        if len(number) and len(self.index):
            p = self.passage_scores(h, number)
            np.maximum.at(worst, doc, p)
            over = np.bincount(doc, p > 0.5, len(texts)).astype(np.int64)
        return worst, over


def train(texts: list[str], flagged: list[int], rounds: int = 2, epochs: int = 3, seed: int = 7) -> Model:
    none = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    y_doc = np.array(flagged)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        return none
    words, parts, n = Words(), [], 0
    for k in range(0, len(texts), 500):
        h, number, doc = passages(words, texts[k : k + 500])
        parts.append((h, (number + n).astype(np.int32), (doc + k).astype(np.int32)))
        n += len(doc)
    h, number, doc = (np.concatenate(x) for x in zip(*parts))
    if not n:
        return none
    rng = np.random.default_rng(seed)
    positive = y_doc[doc] == 1
    # features about as common without a flag as with one, and how often a wording occurs with and without:
    # a rater's error leaves a few abusive passages among the unflagged documents
    with_, plain = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for k in range(0, len(h), 200_000):
        at, of = features(h[k : k + 200_000], number[k : k + 200_000])
        with_ += np.bincount(at[positive[of]], minlength=1 << BITS).astype(np.int32)
        plain += np.bincount(at[~positive[of]], minlength=1 << BITS).astype(np.int32)
    known = plain * (y_doc == 1).sum() * 5.0 > with_ * float((y_doc == 0).sum())
    first = np.searchsorted(number, np.arange(n))
    place = np.arange(len(h)) - first[number]
    kinds, kind = np.unique(np.add.reduceat(h.astype(np.int64) * (2 * place + 1) % 2_147_483_629, first), return_inverse=True)
    with_flag, without = np.bincount(kind, positive, len(kinds)), np.bincount(kind, ~positive, len(kinds))
    carries = ((with_flag + 0.5) * (y_doc == 0).sum() > 3 * (without + 0.5) * (y_doc == 1).sum())[kind]
    # from here on only the flagged documents and a bounded number of other passages
    negative = np.flatnonzero(~positive)
    if len(negative) > PASSAGES:
        negative = rng.permutation(negative)[:PASSAGES]
    use = positive.copy()
    use[negative] = True
    h, number = h[use[number]], (np.cumsum(use) - 1)[number[use[number]]]
    doc, positive, carries = doc[use], positive[use], carries[use]
    n, negative = len(doc), np.flatnonzero(~positive)
    bucket, of = features(h, number)
    order = np.argsort(of, kind="stable")
    bucket, start = bucket[order].astype(np.int32), np.searchsorted(of[order], np.arange(n + 1))
    del of, order
    own = np.flatnonzero(positive & carries)
    y = positive.astype(float)
    length = np.diff(start)
    row = np.repeat(np.arange(n, dtype=np.int32), length)
    novelty = np.bincount(row, ~known[bucket], n) / np.maximum(length, 1)

    def best(v: np.ndarray) -> np.ndarray:
        top = np.zeros(len(texts))
        np.maximum.at(top, doc[own], v[own])
        return top[doc[own]]

    # a flag is carried by passages unlike any of unflagged documents; a flagged document
    # without such a passage is a rater's error
    chosen = own[novelty[own] >= np.maximum(NOVEL, 0.85 * best(novelty))]
    for r in range(rounds):
        rows = np.concatenate([negative, chosen])
        weight = np.where(positive, min(20.0, max(1.0, 0.25 * len(negative) / max(1, len(chosen)))), 1.0)
        f = Ftrl()
        for _ in range(epochs):
            f.fit(bucket, start, y, weight, rng.permutation(rows))
        w = f.weights()
        if r + 1 < rounds:
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[bucket], n) / np.sqrt(np.maximum(length, 1)) + f.bias(), -30, 30)))
            chosen = own[(p[own] >= 0.5) & (novelty[own] >= 0.5 * NOVEL)]
    index = np.flatnonzero(w)
    return Model(index, w[index].astype(np.float32), float(f.bias()))


def labels(votes: DataFrame, doc_id: str, flag: str) -> DataFrame:
    """(doc_id, y): the majority of the votes."""
    mean = votes.where(F.col(flag).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.avg(F.col(flag).cast("double")).alias("m"))
    return mean.where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y"))


def fit(documents: DataFrame, doc_id: str, text: str, votes: DataFrame, votes_id: str, flag: str, bound: int = LABELLED) -> Model:
    picked = labels(votes, votes_id, flag).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(picked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(bound)
    read = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).over(W.orderBy(F.xxhash64("doc_id"), "doc_id", "text"))  # over ``bound`` rows
    texts, ys = [], []
    for r in rows.withColumn("__read", read).where(F.col("__read") <= CHARS).toLocalIterator():
        texts.append(r["text"] or "")
        ys.append(r["y"])
    return train(texts, ys)


def score(documents: DataFrame, model: Model, keep: list[str], text: str) -> DataFrame:
    """Every row: the columns ``keep``, score, n_passages (over one half)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[documents.schema[c] for c in keep], *T._parse_datatype_string("score double, n_passages long").fields])

    def run(batches):
        m = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1_000):
                b = whole.slice(lo, 1_000)
                worst, over = m.score(b.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(np.round(worst, 6)), pa.array(over)], names=schema.names)

    return documents.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def rates(scored: DataFrame, source: str, threshold: float = 0.5) -> DataFrame:
    """(source, n_documents, n_flagged, rate, mean_score)."""
    return scored.groupBy(source).agg(
        F.count("*").alias("n_documents"), F.count(F.when(F.col("score") > threshold, 1)).alias("n_flagged"), F.round(F.avg((F.col("score") > threshold).cast("double")), 6).alias("rate"), F.round(F.avg("score"), 4).alias("mean_score")
    )
