"""Garbled text from wrong character encodings.

A multinomial classifier over hashed byte bigrams predicts for each run of non-ASCII
characters, with the kinds of two characters on either side, by which chain of encodings it was
garbled, or that it is clean. It is trained on the table's own clean runs, garbled synthetically by
every chain. The predicted chain is inverted, and the result is taken only where it decodes strictly;
a run garbled beyond recovery is reported and left as it is. Chains between single-byte encodings
always decode: of these the result is taken only if, in such surroundings, it is more frequent
in the table than the run as it stands, so a clean dash stays a dash.

Runs in their surroundings are counted over all rows by aggregation. The driver keeps those with at least
``SHARE`` of all runs, so at most 1 / SHARE whatever the table; clean are those that no chain inverts into
characters known from the others. Plain ASCII texts are set aside in the JVM, all others are decided
by tasks that hold nothing but the model.

Defined results
* null, empty and ASCII texts hold no garbled run; entities such as "&mdash;" are text;
* a replacement character is always garbled and never restorable;
* repeated rows are reported each; an empty table gives an empty result; without any
  clean run to learn from, only strict inversion into letters decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.runtime import cut

SHARE = 2e-5
#: Share of all clean runs in which a character must occur to count as known; twice at least.
KNOWN = 1e-4
BUCKETS = 1 << 13
RUN = re.compile("[^\x00-\x7f]+")
LOST = "�"
#: (stored as, read as) once or more; "?": bytes without a character are dropped or replaced.
CHAINS = {
    "utf-8>cp1252": [("utf-8", "cp1252")],
    "utf-8>cp1252?": [("utf-8", "cp1252?")],
    "utf-8>latin-1": [("utf-8", "latin-1")],
    "utf-8>cp1252>utf-8>cp1252": [("utf-8", "cp1252"), ("utf-8", "cp1252")],
    "utf-8>latin-1>utf-8>latin-1": [("utf-8", "latin-1"), ("utf-8", "latin-1")],
    "utf-8>mac-roman": [("utf-8", "mac_roman")],
    "utf-8>cp437": [("utf-8", "cp437")],
    "utf-8>cp850": [("utf-8", "cp850")],
    "utf-8>cp1251": [("utf-8", "cp1251")],
    "utf-8>cp1250": [("utf-8", "cp1250")],
    "utf-8>koi8-r": [("utf-8", "koi8_r")],
    "cp1252>mac-roman": [("cp1252", "mac_roman")],
    "cp1252>cp437": [("cp1252", "cp437")],
    "cp1252>cp850": [("cp1252", "cp850")],
    "mac-roman>cp1252": [("mac_roman", "cp1252")],
    "cp1252>cp1251": [("cp1252", "cp1251")],
}
CLEAN = "clean"


def read_bytes(raw: bytes, enc: str) -> str:
    """Decode; Windows code pages pass bytes without a character through, "?" drops them."""
    if enc[-1] == "?":
        return raw.decode(enc[:-1], "ignore")
    if not enc.startswith("cp125"):
        return raw.decode(enc, "replace")
    return "".join(x if (x := bytes([c]).decode(enc, "ignore")) else chr(c) for c in raw)


def garble(text: str, chain: list[tuple[str, str]]) -> str:
    for stored, seen in chain:
        text = read_bytes(text.encode(stored, "ignore"), seen)
    return text


def back_bytes(text: str, enc: str) -> bytes | None:
    """Strict inverse of ``read_bytes``; None where a character cannot come from it."""
    enc = enc.rstrip("?")
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(enc)
        except UnicodeEncodeError:
            if not enc.startswith("cp125") or not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


def invert(text: str, chain: list[tuple[str, str]]) -> str | None:
    """The text before the chain, or None where a step does not decode strictly."""
    for stored, seen in reversed(chain):
        raw = back_bytes(text, seen)
        if raw is None:
            return None
        try:
            text = raw.decode(stored)
        except UnicodeDecodeError:
            return None
    return text


def runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, run in its surroundings) of each non-ASCII run."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        left, right = text[max(0, a - 2) : a], text[b : b + 2]
        out.append((a, b, f"{_plain(left, True)}\x02{m.group()}\x03{_plain(right, False)}"))
    return out


def _plain(s: str, left: bool) -> str:
    """Kinds of characters: letters, capitals, digits, spaces; marks stand for themselves."""
    s = re.sub("[^\x00-\x7f]", "~", re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\s", " ", s)))))
    return s.rjust(2) if left else s.ljust(2)


def bigrams(shown: str) -> np.ndarray:
    b = np.frombuffer(shown.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    return ((b[:-1] * np.uint32(256) + b[1:]) * np.uint32(2654435761) >> np.uint32(19)) % BUCKETS


class Model:
    """Multinomial logistic regression over hashed byte bigrams."""

    def __init__(self, classes: list[str], weights: np.ndarray, seen: dict[str, int], made: dict[str, set[str]]):
        self.classes, self.weights, self.seen, self.made, self.known = classes, weights, seen, made, {}
        self.total: Counter = Counter()
        for s, n in seen.items():
            self.total[s[3:-3]] += n

    def ranked(self, shown: str) -> list[str]:
        """Classes by falling probability."""
        k = bigrams(shown)
        return [self.classes[i] for i in np.argsort(-self.weights[:, k].sum(1) / np.sqrt(len(k)), kind="stable")]

    def decide(self, shown: str) -> tuple[str, str | None]:
        """(chain, restored run or None) of a run in its surroundings."""
        if (got := self.known.get(shown)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[shown] = self._decide(shown)
        return got

    def _decide(self, shown: str) -> tuple[str, str | None]:
        run = shown[3:-3]
        if LOST in run:
            return "lost", None
        ranked = self.ranked(shown)
        if ranked[0] == CLEAN:
            return CLEAN, None
        for chain in ranked:
            if chain == CLEAN:
                break
            back = invert(run, CHAINS[chain])
            if back is not None and single(chain) and not self._likelier(back, shown):
                continue
            if back is not None and back != run and not any(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 for c in back):
                return chain, back
        if single(ranked[0]) or not set(run) <= self.made[ranked[0]]:
            return CLEAN, None
        return ranked[0], None

    def _likelier(self, back: str, shown: str) -> bool:
        """Whether a run is more frequent than the one that stands there: in such surroundings, or, where those are rare, five times in all."""
        own = self.seen.get(shown, 0)
        return self.seen.get(f"{shown[:3]}{back}{shown[-3:]}", 0) > own or own <= 2 and self.total[back] >= 5 * max(1, self.total[shown[3:-3]])


def single(chain: str) -> bool:
    """Whether the chain's bytes stand for any character, so that its inverse proves nothing."""
    return not chain.startswith("utf-8")


def count_runs(texts: list[str]) -> Counter:
    """In how many texts each run stands in its surroundings."""
    seen: Counter = Counter()
    for t in texts:
        seen.update({x[2] for x in runs(t)})
    return seen


def train(seen: dict[str, int], rounds: int = 200) -> Model:
    """Fit on clean runs of the counts and their synthetic garblings."""
    seen = Counter({s: n for s, n in sorted(seen.items()) if LOST not in s})
    back = defaultdict(list)
    for s in seen:
        for name, chain in CHAINS.items():
            if chain[-1][0] == "utf-8" and (r := invert(s[3:-3], chain)) is not None:
                back[s].append(r)
    inventory = Counter()
    for s, n in seen.items():
        if s not in back:
            inventory.update(dict.fromkeys(s[3:-3], n))
    known = max(2, KNOWN * sum(n for s, n in seen.items() if s not in back))
    clean = {s: n for s, n in seen.items() if not any(all(inventory[c] > known for c in r) for r in back[s])}
    examples: dict[str, Counter] = {CLEAN: Counter(clean)}
    for name, chain in CHAINS.items():
        made = Counter()
        for s, n in clean.items():
            g = garble(s[3:-3], chain)
            for a, b, _ in runs(g):
                if g[a:b] != s[3:-3]:
                    left, right = (s[:2] + g[:a])[-2:], (g[b:] + s[-2:])[:2]
                    made[f"{_plain(left, True)}\x02{g[a:b]}\x03{_plain(right, False)}"] += n
        if made:
            examples[name] = made
    classes = list(examples)
    rows = [(k, s, n) for k, c in enumerate(classes) for s, n in examples[c].items()]
    if not rows:
        return Model([CLEAN], np.zeros((1, BUCKETS), np.float32), {}, {})
    used = np.unique(np.concatenate([bigrams(s) for _, s, _ in rows]))
    x = np.zeros((len(rows), len(used)), np.float32)
    for i, (_, s, _) in enumerate(rows):
        k = bigrams(s)
        np.add.at(x[i], np.searchsorted(used, k), 1 / np.sqrt(len(k)))
    y = np.array([k for k, _, _ in rows])
    weight = np.array([n for _, _, n in rows], np.float64)
    weight /= np.bincount(y, weight)[y]
    w, g2 = np.zeros((len(classes), len(used))), np.full((len(classes), len(used)), 1e-8)
    hot = np.eye(len(classes))[y]
    for _ in range(rounds):
        z = x @ w.T
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = ((p - hot) * weight[:, None]).T @ x + 1e-5 * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    full = np.zeros((len(classes), BUCKETS), np.float32)
    full[:, used] = w
    return Model(classes, full, dict(seen), {c: {ch for s in examples[c] for ch in s[3:-3]} for c in classes})


RESULT = "n_garbled int, n_restored int, chains string, restored string"


def counted(texts: DataFrame) -> dict[str, int]:
    """Counts of the runs with at least SHARE of all runs, over all rows of the one column."""

    def run(batches):
        for b in batches:
            seen = count_runs([t for t in b.column(0).to_pylist() if t])
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["shown", "n"])

    counts = cut(texts.mapInArrow(run, "shown string, n long").groupBy("shown").agg(F.sum("n").alias("n")), "runs")
    total = counts.agg(F.sum("n")).head()[0] or 0
    return {r.shown: r.n for r in counts.where(F.col("n") >= SHARE * total).collect()}


def repair(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, n_garbled, n_restored, chains, restored): rows with at least one garbled run."""
    spark = df.sparkSession
    foreign = df.where(F.col(text).rlike("[^\\x00-\\x7F]")).select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    model = spark.sparkContext.broadcast(train(counted(foreign.select("text"))))
    schema = T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *T._parse_datatype_string(RESULT).fields])

    def run(batches):
        m = model.value
        for b in batches:
            keep, out = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                parts, last, n, ok, chains = [], 0, 0, 0, set()
                for a, e, shown in runs(t):
                    chain, back = m.decide(shown)
                    if chain == CLEAN:
                        continue
                    n += 1
                    chains.add(chain)
                    if back is not None:
                        ok += 1
                        parts += [t[last:a], back]
                        last = e
                if n:
                    keep.append(i)
                    out.append((n, ok, ",".join(sorted(chains)), "".join([*parts, t[last:]])))
            if keep:
                cols = [pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *cols], names=schema.names)

    return foreign.mapInArrow(run, schema)
