"""Plug points for models outside the engine: embedding, reranking, entailment, generation.

Nothing here reaches the network; a provider is a function on lists of texts, given by the
caller and called once per batch inside the tasks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]
Generator = Callable[[str], str]

_EMBEDDERS: dict[str, Callable[[], Embedder]] = {}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    """make is called once per worker, so a model is loaded once."""
    _EMBEDDERS[name] = make


def embed_with(df: DataFrame, name: str, keep: list[str], text: str, batch: int = 96) -> DataFrame:
    """The columns ``keep`` and unit vectors of a registered provider, in batches of its size."""
    make = _EMBEDDERS[name]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in it:
            out: list[list[float]] = []
            texts = b[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                for v in model(texts[i : i + batch]):
                    n = sum(x * x for x in v) ** 0.5 or 1.0
                    out.append([x / n for x in v])
            yield b[keep].assign(vec=out)

    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def score_with(df: DataFrame, make: Callable[[], Scorer], keep: list[str], left: str, right: str, name: str = "score") -> DataFrame:
    """The columns ``keep`` and a score of each pair of texts: reranking and entailment."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in it:
            yield b[keep].assign(**{name: model(b[left].fillna("").tolist(), b[right].fillna("").tolist())})

    return df.select(*dict.fromkeys([*keep, left, right])).mapInPandas(run, schema)


class Busy(Exception):
    """Raised by a generator that asks to be called later, with the seconds to wait if known."""

    def __init__(self, wait: float | None = None):
        super().__init__("busy")
        self.wait = wait


Fetcher = Callable[[str], bytes]


def fetch_with(df: DataFrame, make: Callable[[], Fetcher], keep: list[str], address: str, tries: int = 1, pause: float = 3.0, batch: int = 32) -> DataFrame:
    """The columns ``keep``, content and error of each address: the adapter for files that a service holds.

    A fetcher is given by the caller and made once per worker; it raises ``Busy`` to be asked again. A
    failure is a row with its error, so one missing file never ends a run.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def one(fetch: Fetcher, where: str | None) -> tuple[bytes | None, str | None]:
        if not where:
            return None, "no address"
        for i in range(tries):
            try:
                return fetch(where), None
            except Busy as e:
                if i + 1 < tries:
                    time.sleep(pause * 2**i if e.wait is None else e.wait)
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"
        return None, "busy"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()
        for whole in it:
            for k in range(0, len(whole), batch):  # a few files in memory at a time
                b = whole.iloc[k : k + batch]
                got = [one(fetch, x) for x in b[address]]
                yield b[keep].assign(content=[x for x, _ in got], error=[e for _, e in got])

    return df.select(*dict.fromkeys([*keep, address])).mapInPandas(run, schema)


def generate_with(df: DataFrame, make: Callable[[], Generator], keep: list[str], prompt: str, tries: int = 5, pause: float = 3.0) -> DataFrame:
    """The columns ``keep`` and the answer; null after the last try. Waits double from try to try unless told."""
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("answer", T.StringType())])

    def one(model: Generator, text: str) -> str | None:
        for i in range(tries):
            try:
                return model(text)
            except Busy as e:
                time.sleep(pause * 2**i if e.wait is None else e.wait)
        return None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in it:
            yield b[keep].assign(answer=[one(model, t) for t in b[prompt]])

    return df.select(*dict.fromkeys([*keep, prompt])).mapInPandas(run, schema)
