"""Splitting oversized texts at natural boundaries by content-defined chunking.

A polynomial rolling hash over windows of words marks landmarks that depend on nothing but
the words in the window. From the start of a piece, the first landmark between the
minimum and the maximum size is snapped to the nearest natural boundary (end of a
paragraph or sentence, else of a clause); an edit therefore changes the pieces around
it and leaves the others as they were. The next piece starts the specified number of
words before the cut.

Only texts over the limit reach Python: a length test (n words take at least 2n - 1
characters) comes before the word count, and both run in the JVM.

Defined results
* words are runs without Unicode white space; a text of at most ``limit`` words, a
  null and a blank text give no pieces;
* every piece has at most ``limit`` words, and consecutive pieces share exactly
  ``overlap`` words;
* a text without any natural boundary in reach is cut at its landmark, without a
  landmark at the limit;
* repeated rows each give their pieces; further columns are carried along when named
  in ``keep`` and may have any names but those of the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.llm.words import JAVA_NON_SPACE, NON_SPACE

PIECE = "piece_no int, n_pieces int, start_word int, n_words int, overlap_words int, boundary string, piece string"
ENDS, CLOSERS = ".!?।॥…", "\"'”’)]»"
#: Short words with a full stop that do not end a sentence.
ABBREVIATIONS = frozenset("v. vs. no. nos. rs. mr. mrs. ms. dr. smt. kum. crl. art. sec. ors. anr. ltd. co. pvt. i.e. e.g. m/s. st. h.no. para. vol. p. pp. ph.".split())
WINDOW, BASE = 8, np.uint64(0x9E3779B97F4A7C15)


def boundaries(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Kind of the boundary after each word: 3 paragraph, 2 sentence, 1 clause, 0 none."""
    kind = np.zeros(len(spans), np.int8)
    for i in range(len(spans) - 1):
        a, b = spans[i]
        nxt = spans[i + 1][0]
        if "\n" in text[b:nxt]:
            before = text[a:b].rstrip(CLOSERS)
            kind[i] = 3 if "\n" in text[b:nxt].replace("\n", "", 1) or before[-1:] in ENDS + ":" else 1
            continue
        w = text[a:b].rstrip(CLOSERS)
        if w[-1:] in ENDS and w.lower() not in ABBREVIATIONS and not (len(w) == 2 and w[0].isupper()):
            first = text[nxt : nxt + 2].lstrip("\"'“‘([«")[:1]
            kind[i] = 2 if not first.islower() else 1
        elif w[-1:] in ",;:":
            kind[i] = 1
    if len(spans):
        kind[-1] = 3
    return kind


def landmarks(words: list[str], divisor: int) -> np.ndarray:
    """Positions whose preceding window of words hashes to zero modulo the divisor."""
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) + np.uint64(1)
    rolled, power = np.zeros_like(h), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            rolled[j:] += h[: len(h) - j] * power
            power *= BASE
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    hits = np.flatnonzero((rolled >> np.uint64(32)) % np.uint64(divisor) == 0)
    return hits[hits >= WINDOW - 1]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, str, int, int]]:
    """(first word, end word, boundary, start char, end char) of each piece; [] within the limit."""
    spans = [m.span() for m in NON_SPACE.finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    least = max(overlap + 1, limit // 3)
    kind = boundaries(text, spans)
    strong, weak = np.flatnonzero(kind >= 2), np.flatnonzero(kind == 1)
    marks = landmarks([text[a:b] for a, b in spans], max(2, (limit - least) // 4))
    out, s = [], 0
    while n - s > limit:
        lo, hi = s + least - 1, s + limit - 1  # index of the piece's last word
        k = np.searchsorted(marks, lo)
        mark = int(marks[k]) if k < len(marks) and marks[k] <= hi else hi
        for places, name in ((strong, ""), (weak, "clause")):
            near = places[np.searchsorted(places, lo) : np.searchsorted(places, hi, "right")]
            if len(near):
                e = int(near[np.argmin(np.abs(near - mark))])
                name = name or ("paragraph" if kind[e] == 3 else "sentence")
                break
        else:
            e, name = mark, "word"
        out.append((s, e + 1, name, spans[s][0], spans[e][1]))
        s = e + 1 - overlap
    out.append((s, n, "end", spans[s][0], spans[n - 1][1]))
    return out


def split_oversized(df: DataFrame, text: str, limit: int, overlap: int, keep: list[str]) -> DataFrame:
    """Rows over the limit as ordered pieces, with the columns ``keep``."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    large = df.where(F.length(text) >= 2 * limit + 1).where(F.regexp_count(text, F.lit(JAVA_NON_SPACE)) > limit).select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([large.schema[c] for c in keep] + T._parse_datatype_string(PIECE).fields)

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                found = cuts(t, limit, overlap)
                if not found:
                    continue
                k = len(found)
                kept = [pa.array([b.column(j)[i]] * k, b.schema[j].type) for j in range(len(keep))]
                new = [
                    pa.array(range(k), pa.int32()),
                    pa.array([k] * k, pa.int32()),
                    pa.array([x[0] for x in found], pa.int32()),
                    pa.array([x[1] - x[0] for x in found], pa.int32()),
                    pa.array([0] + [overlap] * (k - 1), pa.int32()),
                    pa.array([x[2] for x in found], pa.string()),
                    pa.array([t[x[3] : x[4]] for x in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(kept + new, names=schema.names)

    return large.mapInArrow(run, schema)
