"""Noise in text from scanned pages: cut words, misread characters, running headers.

A frequency lexicon and a bigram table are counted over the whole corpus. Words that are
frequent enough to be corrections are indexed by their symmetric deletes; a suspicious word
looks up its own deletes, and a weighted edit distance in which only confusions that
scanners make are cheap decides which candidates explain it. Among several, bigram
context picks the repair. A letter-only word is suspicious only if a candidate is many times as
frequent, so names and rare words that exist side by side stay as they are.

The lexicon kept by the driver and its broadcast hold words with at least ``SHARE`` of all
running words, so at most 1 / SHARE of them whatever the corpus; counting itself
covers every text and is combined before the shuffle.

Defined results
* null and blank fields have no noise; repeated rows are reported each;
* mere line wrapping, upper case, paragraph numbers and proper hyphens are kept: a hyphen at
  a line end is a cut only if the corpus does not know the hyphenated form better;
* page numbers and headers are whole lines in texts, and the edges of a name;
* an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.runtime import cut

SHARE = 2e-6
#: Times by which a correction must be more frequent than a letter-only word: one of the
#: lexicon, and a rarer one of this length, held to be as frequent as the lexicon's rarest.
RATIO_KNOWN = 200
RATIO = {3: 50, 4: 12}
RATIO_LONG = 6
#: What a scanner reads for what stands there.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("s", "5"), ("i", "!"), ("l", "!"), ("l", "|"), ("i", "|"), ("b", "6"), ("g", "6"), ("g", "9"), ("q", "9"), ("b", "8"), ("t", "7"), ("e", "3"), ("z", "2"), ("a", "@"), ("s", "$"), ("a", "4"),
    ("i", "l"), ("l", "i"), ("e", "c"), ("c", "e"), ("a", "o"), ("o", "a"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("g", "q"), ("q", "g"), ("u", "v"), ("v", "u"), ("n", "u"), ("u", "n"),
    ("m", "rn"), ("rn", "m"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("n", "ri"), ("h", "li"), ("k", "lc"),
]
CHEAP = 0.3
#: Confusions that a repair of less than one edit can hold.
MOST_CONFUSED = 3
#: Characters of the longest running header.
HEADER = 200
_BY_SEEN: dict[str, list[str]] = {}
for _true, _seen in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_true)
_SYMBOL = "0-9!|@$"
TOKEN = re.compile(r"[!|@$]?\d*[^\W\d_][^\W_]*(?:[!|@$]+[^\W_]+)*[!|@$]?")
HYPHENATED = re.compile(r"[^\W\d_]+-[^\W\d_]+")
#: A hyphen, soft hyphen or not sign at the end of a line.
BREAK = re.compile("(?<=[^\\W\\d_])([-\xad\xac\u2010\u2011])[ \\t]*\\n[ \\t]*(?=[^\\W\\d_])")
_LAST, _FIRST = re.compile(r"[^\W\d_]+$"), re.compile(r"[^\W\d_]+")
_NUMBER = r"(?:\[ ?\d{1,4} ?\]|\( ?\d{1,4} ?\)|[-–—] ?\d{1,4} ?[-–—]|p ?a ?g ?e\.? ?\d{1,4}(?: ?(?:of|/) ?\d{1,4})?|pg\.? ?\d{1,4}|p\. ?\d{1,4}|\.{3,} ?\d{1,4}|\d{1,4} ?/ ?\d{1,4}|\d{1,4})"
PAGE_LINE = re.compile(rf"^[ \t]*{_NUMBER}[ \t]*$", re.I)
NAME_HEAD = re.compile(rf"^\s*{_NUMBER}\s+(?=\S)", re.I)
NAME_TAIL = re.compile(r"(?:\s{2,}page ?\d{1,4}(?: ?(?:of|/) ?\d{1,4})?|\s*\.{3,} ?\d{1,4}|\s*\| ?p\. ?\d{1,4}|\s+pg\.? ?\d{1,4}|\s{2,}\[?\(?\d{1,4}\)?\]?)\s*$", re.I)
#: "12  A v. B", possibly cut off, or "A v. B    W.P. 12/2020".
HEADER_LINE = re.compile(r"^[ \t]*(?:\d{1,4}[ \t]{2,}\S.{2,110}?\s[vV]\b.{0,80}|\d{1,4}[ \t]{2,}(?-i:(?:[A-Z(&][^\s]*|of|and|the)(?: (?:[A-Z(&][^\s]*|of|and|the|\d+)){0,9}) ?|\S.{2,110}?\sv\.? .{0,80}?[ \t]{2,}\S.{0,30}\d{1,6}/\d{4}|\S.{2,110}?\sv\.? .{0,80}?[ \t]{2,}\d{1,4})[ \t]*$", re.I)
CAPS_TITLE = re.compile(r"^[^a-z]{3,110}\sV\.? [^a-z]{2,80}$")
ADDRESS_LIKE = re.compile(r"[\w.+\-]+ ?@ ?[\w\-]+\.[\w.\-]+|https?://\S+|www\.\S+")


def tokens(lex: "Lexicon", text: str) -> list[str]:
    return [lex.bare(t) for t in TOKEN.findall(text.lower())]


def variants(word: str) -> list[str]:
    """The word, and the word with digits and letter groups read back.

    A correction is of letters only and less than one edit away, so every symbol must be a confusion, and of
    more than ``MOST_CONFUSED`` symbols none can come of it: what is left out could not be taken.
    """
    at = [k for k, c in enumerate(word) if not c.isalpha()]
    if len(at) > MOST_CONFUSED or not all(word[k] in _BY_SEEN for k in at):
        return [word]
    out = {word}
    for choice in itertools.product(*[_BY_SEEN[word[k]] for k in at]):
        x = list(word)
        for k, c in zip(at, choice):
            x[k] = c
        out.add("".join(x))
    for seen in ("vv", "ii", "cl", "rn", "li"):
        out |= {w.replace(seen, t) for w in out if seen in w for t in _BY_SEEN.get(seen, [])}
    return sorted(out)


def distance(seen: str, true: str, most: float = 1.0) -> float:
    """Weighted edit distance; confusions are cheap."""
    a, b = len(seen), len(true)
    if abs(a - b) > 4:
        return 9.0
    d = [[9.0] * (b + 1) for _ in range(a + 1)]
    d[0][0] = 0.0
    for i in range(a + 1):
        row_min = 9.0
        for j in range(b + 1):
            if not i and not j:
                row_min = 0.0
                continue
            v = 9.0
            if i and d[i - 1][j] + 1 < v:
                v = d[i - 1][j] + 1
            if j and d[i][j - 1] + 1 < v:
                v = d[i][j - 1] + 1
            if i and j:
                v = min(v, d[i - 1][j - 1] + (seen[i - 1] != true[j - 1]))
            for m in (1, 2):
                if i >= m:
                    for t in _BY_SEEN.get(seen[i - m : i], ()):
                        if j >= len(t) and true[j - len(t) : j] == t:
                            v = min(v, d[i - m][j - len(t)] + CHEAP)
            d[i][j] = v
            row_min = min(row_min, v)
        if row_min > most + 1:
            return 9.0
    return d[a][b]


def deletes(word: str, most: int = 2) -> set[str]:
    out, edge = {word}, {word}
    for _ in range(most):
        edge = {w[:k] + w[k + 1 :] for w in edge for k in range(len(w)) if len(w) > 2}
        out |= edge
    return out


class Lexicon:
    """Frequent words, their symmetric-delete index and bigrams."""

    def __init__(self, words: dict[str, int], hyphenated: dict[str, int], bigrams: dict[str, int], least: int):
        self.words, self.hyphenated, self.bigrams, self.least = words, hyphenated, bigrams, least
        self.index: dict[str, list[str]] | None = None
        self.clean: set[str] = set()
        self.raw: set[str] = set()
        self.fixes: dict[str, list[str]] = {}

    def __getstate__(self):
        return self.words, self.hyphenated, self.bigrams, self.least

    def __setstate__(self, s):
        self.__init__(*s)

    def _build(self) -> None:
        self.index = {}
        for w, n in self.words.items():
            if len(w) >= 2 and w.isalpha() and n >= 2 * self.least:
                for x in deletes(w, 2 if len(w) > 4 else 1):
                    self.index.setdefault(x, []).append(w)

    def bare(self, word: str) -> str:
        """Without a mark at its end that is no part of it."""
        if word[-1] in "!|@$" and (word[-1] == "!" and not self._read(word) or word[:-1] in self.words):
            return word[:-1]
        return word

    def _read(self, word: str) -> bool:
        return word[:-1] not in self.words and any(v in self.words for v in variants(word))

    def candidates(self, word: str) -> list[str]:
        """Corrections of a word, best first; empty for a word that stands."""
        letters = sum(c.isalpha() for c in word)
        marked = letters < len(word)
        if marked and (letters * 2 < len(word) or not any(c.isalpha() for c in word)):
            return []
        if not marked and len(word) < 3:
            return []
        if self.index is None:
            self._build()
        if marked:
            need = self.least
        elif word in self.words:
            need = self.words[word] * RATIO_KNOWN
        else:
            need = self.least * RATIO.get(len(word), RATIO_LONG)
        found = {}
        for v in variants(word):
            for x in deletes(v, 2 if len(v) > 4 else 1):
                for c in self.index.get(x, ()):
                    if c != word and c not in found and self.words[c] >= need:
                        found[c] = distance(word, c)
        good = [c for c in found if found[c] < 1]
        near = min((found[c] for c in good), default=0) + CHEAP + 0.01  # context decides among repairs with one confusion more
        return sorted((c for c in good if found[c] <= near), key=lambda c: (round(found[c], 2), -self.words[c], c))

    def look(self, word: str) -> list[str]:
        if word in self.clean:
            return []
        got = self.fixes.get(word)
        if got is None:
            if len(self.clean) > 300_000:
                self.clean.clear()
            if len(self.fixes) > 100_000:
                self.fixes.clear()
            got = self.candidates(word)
            if got:
                self.fixes[word] = got
            else:
                self.clean.add(word)
        return got

    def pick(self, options: list[str], before: str, after: str) -> str:
        if len(options) == 1:
            return options[0]
        return max(options, key=lambda c: (self.bigrams.get(f"{before} {c}", 0) + self.bigrams.get(f"{c} {after}", 0), self.words[c]))

    def is_cut(self, a: str, b: str) -> bool:
        """Whether "a-" and "b" on the next line are one word."""
        known = self.hyphenated.get(f"{a}-{b}", 0)
        return known == 0 or self.words.get(a + b, 0) > known


def as_shown(fix: str, seen: str, name: bool) -> str:
    if seen.upper() == seen and sum(c.isalpha() for c in seen) > 1:
        return fix.upper()
    if seen[0].isupper() or (name and not seen[0].isalpha() and fix not in ("of", "and", "the", "v", "through")):
        return fix[0].upper() + fix[1:]
    return fix


def _odd(w: str) -> bool:
    """A word of letters with one or two symbols among them."""
    letters = sum(c.isalpha() for c in w)
    return 3 <= letters < len(w) <= letters + 2 and any(c.isalpha() for c in w[1:])


def mend_words(lex: Lexicon, text: str, name: bool) -> tuple[str, int]:
    """Repair misread words; number of repairs."""
    fresh = set(text.split()) - lex.raw
    stands = {r for r in fresh if not any(lex.look(w) or _odd(w) for w in tokens(lex, r))}
    if len(lex.raw) > 300_000:
        lex.raw.clear()
    lex.raw |= stands
    if len(stands) == len(fresh):
        return text, 0
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    skip = [m.span() for m in ADDRESS_LIKE.finditer(text)] if "@" in text or "/" in text else []
    parts, last, n, before = [], 0, 0, ""
    found = list(TOKEN.finditer(low))
    for k, m in enumerate(found):
        w = lex.bare(m.group())
        options = lex.look(w)
        if (options or _odd(w)) and not any(a <= m.start() < b for a, b in skip):
            start = m.start() + m.group().find(w)
            shown = text[start : start + len(w)]
            if options:
                after = found[k + 1].group() if k + 1 < len(found) else ""
                fix = lex.pick(options, before, after)
                parts += [text[last:start], as_shown(fix, shown, name)]
                last = start + len(w)
                n += 1
                w = fix
            elif _misread_shape(shown) and (name or low[start - 1 : start] not in ("-", "_", "/", ".", "@", "+") and not re.match(r"[@_/\-+]|\.\w", low[start + len(w) :])):
                n += 1
        before = w
    return "".join([*parts, text[last:]]), n


def _misread_shape(shown: str) -> bool:
    """One or two symbols in a word otherwise of letters, not at its end in bulk as in a login."""
    return bool(re.fullmatch(r"[^\W\d_]*[0-9!|@$]?[^\W\d_]+[0-9!|@$]?[^\W\d_]*", shown)) and any(c.islower() for c in shown) and not re.fullmatch(r"\d+[^\W\d_]{1,2}", shown)


def drop_page_lines(text: str) -> tuple[str, int]:
    """Without page numbers and running headers that stand as lines; number of them."""
    lines = text.split("\n")
    keep, gone = [], 0
    for ln in lines:
        if 0 < len(ln.strip()) < HEADER and (PAGE_LINE.match(ln) or ((" v" in ln or " V" in ln or ln.lstrip()[:1].isdigit()) and (HEADER_LINE.match(ln) and not ln.rstrip().endswith((";", ",")) or CAPS_TITLE.match(ln)))):
            gone += 1
        else:
            keep.append(ln)
    return "\n".join(keep), gone


def join_cuts(lex: Lexicon, text: str) -> tuple[str, int]:
    if "\n" not in text or not any(c in text for c in "-\xad\xac\u2010\u2011"):
        return text, 0
    n = 0

    def put(m):
        nonlocal n
        a, b = _LAST.search(text[max(0, m.start() - 40) : m.start()]).group(), _FIRST.match(text[m.end() : m.end() + 40]).group()
        if m.group(1) == "-" and not lex.is_cut(a.lower(), b.lower()):
            return "-"
        n += 1
        return ""

    return BREAK.sub(put, text), n


def reflow(text: str) -> str:
    """Hard-wrapped lines as paragraphs."""
    lines = text.split("\n")
    long = [len(x) for x in lines if len(x) > 30]
    if len(long) < 3 or max(long) > 110:
        return text
    width, out = max(long), [lines[0]]
    for a, b in zip(lines, lines[1:]):
        wrapped = a.strip() and b.strip() and len(a) + 1 + len(b.split(" ", 1)[0]) > width - 8 and not re.match(r"\d{1,3}\. ", b)
        if wrapped or (b[:1].islower() and a[-1:] not in ".!?:।"):
            out[-1] += " " + b.strip()
        else:
            out.append(b)
    return "\n".join(out)


def repair_field(lex: Lexicon, value: str, name: bool) -> tuple[str, int, int, int]:
    """(repaired, cut words, misread words, headers and page numbers)."""
    if not value or not value.strip():
        return value, 0, 0, 0
    if name:
        text = NAME_TAIL.sub("", NAME_HEAD.sub("", value, count=1))
        heads = int(text != value)
    else:
        text, heads = drop_page_lines(value)
    text, cuts = join_cuts(lex, text)
    text, misread = mend_words(lex, text, name)
    return (" ".join(text.split()) if name else reflow(text)), cuts, misread, heads


def _counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(kind, term, n): words, hyphenated words and bigrams of all fields."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 2_000):
                raw = []
                for col in b.columns:
                    for t in col.slice(k, 2_000).to_pylist():
                        if t:
                            raw += t.split()
                            raw.append("\n")
                if not raw:
                    continue
                number = {t: i for i, t in enumerate(dict.fromkeys(raw))}
                ids = np.fromiter(map(number.__getitem__, raw), np.int64, len(raw))
                times = np.bincount(ids)
                words, hyphens, names = Counter(), Counter(), [""]
                single = np.zeros(len(number), np.int64)  # number of the one word of a raw word
                known: dict[str, int] = {}
                for i, t in enumerate(number):
                    low = t.lower()
                    found = TOKEN.findall(low)
                    for w in found:
                        words[w] += int(times[i])
                    if len(found) == 1:
                        single[i] = known.setdefault(found[0], len(known) + 1)
                    elif "-" in low:
                        for w in HYPHENATED.findall(low):
                            hyphens[w] += int(times[i])
                names += known
                seq = single[ids]
                pairs, often = np.unique((seq[:-1] << 32 | seq[1:])[(seq[:-1] > 0) & (seq[1:] > 0)], return_counts=True)
                terms = [*words, *hyphens, *(f"{names[c >> 32]} {names[c & 0xFFFFFFFF]}" for c in pairs.tolist())]
                kinds = ["w"] * len(words) + ["h"] * len(hyphens) + ["b"] * len(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(terms, pa.string()), pa.array([*words.values(), *hyphens.values(), *often.tolist()], pa.int64())], names=["kind", "term", "n"])

    return df.select(*fields).mapInArrow(run, "kind string, term string, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, fields: list[str], share: float = SHARE) -> Lexicon:
    counts = cut(_counts(df, fields), "terms")
    total = counts.where("kind = 'w'").agg(F.sum("n")).head()[0] or 0
    least = max(2, int(np.ceil(share * total)))
    got: dict[str, dict[str, int]] = {"w": {}, "h": {}, "b": {}}
    floor = {"w": least, "h": least, "b": 2 * least}
    keep = F.lit(False)
    for kind, n in floor.items():
        keep |= (F.col("kind") == kind) & (F.col("n") >= n)
    for r in counts.where(keep).collect():
        term = r.term.rstrip("!")
        got[r.kind][term] = r.n + got[r.kind].get(term, 0)
    return Lexicon(got["w"], got["h"], got["b"], least)


RESULT = "field_name string, n_cut int, n_misread int, n_headers int, repaired string"


def repair(df: DataFrame, row_id: str, text_fields: list[str], name_fields: list[str]) -> DataFrame:
    """(row_id, field_name, n_cut, n_misread, n_headers, repaired) of each noisy field."""
    fields = [*text_fields, *name_fields]
    lex = df.sparkSession.sparkContext.broadcast(lexicon(df, fields))
    schema = T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *T._parse_datatype_string(RESULT).fields])

    def run(batches):
        x = lex.value
        for b in batches:
            keep, out = [], []
            for k, f in enumerate(fields):
                for i, v in enumerate(b.column(k + 1).to_pylist()):
                    if v:
                        text, cuts, misread, heads = repair_field(x, v, f in name_fields)
                        if cuts or misread or heads:
                            keep.append(i)
                            out.append((f, cuts, misread, heads, text))
            if keep:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *[pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)]], names=schema.names)

    return df.select(F.col(row_id).alias("row_id"), *fields).mapInArrow(run, schema)
