"""Filling fixed-capacity containers by Karmarkar-Karp multiway differencing.

Sizes are counted once per document in tokens of a public tokenizer. Items are hashed into
blocks of about ``windows`` containers, so that no task holds more than one block and the
number of blocks follows the total. In a block the differencing method starts from as many
containers as the sum demands: the two partial partitions with the largest imbalances
are merged with opposing order until one is left. Where a container comes out over the
capacity, the block is solved again with one container more.

Defined results
* null and empty texts have no tokens and are not packed; repeated rows are packed each;
* an item over the capacity is cut into full pieces, each alone in a container, and a
  rest that is packed like any item; no other item is cut;
* no container is over the capacity; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.runtime import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Entries of a worker's cache of counted chunks; beyond it the cache starts anew.
CACHE = 400_000
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


class Counter:
    """Tokens of a text under a byte-level BPE that cuts before single spaces.

    Such a tokenizer treats " word" alike wherever it stands, so counts of chunks between
    single spaces add up exactly and can be kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.t.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not text:
            return 0
        chunks = _SINGLE.split(text) if "  " in text or " \n" in text or "\n " in text or "\t" in text or text[-1] == " " or text[0] == " " else text.split(" ")
        known, rest = self.known, chunks[1:]
        try:
            n = sum(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for c in set(rest):
                if c not in known:
                    known[c] = self.whole(" " + c)
            n = sum(map(known.__getitem__, rest))
        return n + self.whole(chunks[0])


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every row with a text."""
    schema = T.StructType([T.StructField("doc_id", df.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        c = counter(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0).mapInArrow(run, schema)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of the items of each of k parts.

    A partial partition is a list of (sum, node) in falling order without its empty parts; a node
    is an item or a pair of nodes.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            parts = a + b
        else:  # the smallest parts of one meet the largest of the other
            keep = len(a) - over
            meet = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[keep:], reversed(b[len(b) - over :]))] if over <= len(b) else []
            parts = a[:keep] + meet + b[: len(b) - over]
        parts.sort(key=lambda x: -x[0])
        low = parts[-1][0] if len(parts) == k else 0
        heapq.heappush(heap, (low - parts[0][0], serial, parts))
        serial += 1
    out = []
    for _, node in heap[0][2] if heap else []:
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(items)
    return out


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts within the capacity, as few as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return parts
        k += 1


ROWS = "pack string, container_id string, doc_id {}, piece_no int, start_token long, n_tokens long"


def pack(counts: DataFrame, capacities: dict[str, int], windows: int = 64) -> DataFrame:
    """(pack, container_id, doc_id, piece_no, start_token, n_tokens) for each named capacity.

    counts: (doc_id, n_tokens); written once, because every capacity reads it and the
    number of blocks depends on its total.
    """
    # equal rows are told apart by their number among themselves, so a container holds the same documents however the table lies
    same = counts.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("c"))
    tens = same.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / 1_000))))
    each = F.sequence(F.col("k") * 1_000, F.least(F.col("k") * 1_000 + 999, F.col("c") - 1))
    counts = cut(tens.select("doc_id", "n_tokens", F.explode(each).alias("row")), "token-counts")
    total = counts.agg(F.sum("n_tokens")).head()[0] or 0
    sized = None
    for name, cap in sorted(capacities.items()):
        blocks = max(1, round(total / (cap * windows)))
        pieces = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / cap)).cast("array<int>")
        one = (
            counts.where("n_tokens > 0")
            .select("doc_id", "n_tokens", "row", F.explode(pieces).alias("piece_no"))
            .select(
                F.lit(name).alias("pack"),
                F.lit(cap).alias("capacity"),
                F.pmod(F.xxhash64("doc_id", "piece_no", "row"), F.lit(blocks)).alias("block"),
                "doc_id",
                "piece_no",
                (F.col("piece_no").cast("long") * cap).alias("start_token"),
                F.least(F.lit(cap).cast("long"), F.col("n_tokens") - F.col("piece_no").cast("long") * cap).alias("n_tokens"),
            )
        )
        sized = one if sized is None else sized.unionByName(one)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no", "n_tokens"], kind="stable").reset_index(drop=True)
        of = [0] * len(pdf)
        for j, part in enumerate(fill(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))):
            for i in part:
                of[i] = j
        pdf["container_id"] = [f"{b}-{j}" for b, j in zip(pdf["block"], of)]
        return pdf[["pack", "container_id", "doc_id", "piece_no", "start_token", "n_tokens"]]

    return sized.groupBy("pack", "block").applyInPandas(solve, ROWS.format(counts.schema["doc_id"].dataType.simpleString()))


def containers(packed: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(pack, container_id, n_items, n_tokens, fill) of each container."""
    cap = F.create_map(*[F.lit(x) for kv in sorted(capacities.items()) for x in kv])
    return packed.groupBy("pack", "container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("fill", F.round(F.col("n_tokens") / cap[F.col("pack")], 6))
