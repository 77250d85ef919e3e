"""Personal information inside free text, by a skip-chain conditional random field.

A document is a linear chain over all its tokens. Repeated or similar tokens (equal letters,
or equal but for vowels, doubled letters and usual scanner confusions) are linked by skip
edges, each occurrence to the one before, so a document has no more skip edges than tokens.
Loopy sum-product passes messages over chain and skip edges; an entity that its context
betrays once is found where its context says little. Labels are then held against the exact
form of their type.

Potentials of a token and its neighbours are sums of hashed features. What depends on one
token is added up once per distinct token and looked up afterwards; a few pair features are
added per place. A token whose potentials prefer "no case" by more than all messages
together could turn keeps it, and messages run over the other tokens only; the bound comes from the chain
and skip potentials and from what the neighbours may be at most, up to ``SURE`` in log-odds. So the whole text is
read, and nothing is cut around patterns.

Potentials, chain and skips are fitted jointly on synthetic documents (``synthetic``): invented
persons, numbers and addresses in sentences written for this module, look-alikes that are no
case, and entities that come again. Names of the party columns are one feature: a bit field of
2^24 bits filled by aggregation, of one size whatever the number of names.

Defined results
* null and blank fields hold nothing; repeated rows are reported each;
* judges, institutions, firms and parties in case titles are no private names, and a
  name inside an e-mail address belongs to the address;
* placeholders replace the found spans and leave the text around them unchanged;
* an empty table gives an empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eralex.llm import synthetic
from eralex.llm.synthetic import ADDRESS, EMAIL, IDENTITY, NAME, PHONE, LABELS, O

PLACEHOLDER = {EMAIL: "[EMAIL]", PHONE: "[PHONE]", IDENTITY: "[IDENTITY NUMBER]", ADDRESS: "[ADDRESS]", NAME: "[NAME]"}
BITS, LIST_BITS, K = 17, 24, len(LABELS)
#: Log-odds left over when a token is held to be no case without messages.
SURE = 6.0
#: A word; one that is cut at a line end counts as one.
SPLIT = re.compile(r"((?<!-)\s+|(?<=-)(?!\n[a-z])\s+)")
TOKEN = re.compile(r"[^\s,;()<>\"\[\]]+?-\n[a-z]+|[^\s,;()<>\"\[\]]*[^\s,;()<>\"\[\].:!?](?:[.](?=(?:\s|,|$)))?|[^\s]")
_FOLD_DIGITS = str.maketrans("123456789", "000000000")
_VERSUS = ("v.", "v", "vs.", "vs", "versus")
SPAN = 3  # tokens on either side that bear on a token


def skeleton(word: str) -> str:
    """What similar spellings of a name share."""
    w = word.replace("rn", "m").replace("cl", "d").replace("vv", "w")
    w = w[:1] + re.sub(r"[aeiouyl0]", "", w[1:])
    return re.sub(r"(.)\1+", r"\1", w)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt * 0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x = x * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


class Grown:
    """A numpy array that grows by doubling."""

    def __init__(self, width: tuple, dtype):
        self.a, self.n = np.zeros((1024, *width), dtype), 0

    def add(self, rows: np.ndarray) -> None:
        n = self.n + len(rows)
        if n > len(self.a):
            self.a = np.concatenate([self.a, np.zeros((max(n, 2 * len(self.a)) - len(self.a), *self.a.shape[1:]), self.a.dtype)])
        self.a[self.n : n] = rows
        self.n = n


def attributes(token: str, names: np.ndarray | None) -> tuple[int, int, int, int, int, int, int]:
    """(low, shape, tail, listed, link, similar, versus) of a token with digits folded.

    tail: the last letters, or of a code its make-up; listed: bit 1 a given name, bit 2 a surname.
    """
    t = token.replace("-\n", "")
    coded = "0" in t or "@" in t
    if coded and len(t) > 1:
        t = t.rstrip(".")
    w = t.lower()
    s = re.sub(r"[^\W\d_A-Z]{2,}", "aa", re.sub(r"[A-Z]{6,}", "AAAAAA", re.sub(r"[^\W\d_A-Z]", "a", re.sub("[A-Z]", "A", w if "@" in t else t))))
    if s[0] == "A":
        s = re.sub(r"A{3,}(?!0)", "AAA", s)
    bare = w.strip(".'’")
    bare = bare[:-2] if bare.endswith(("'s", "’s")) else bare
    listed = sum(1 << i for i in (0, 1) if names is not None and _listed(names, i, bare))
    capital = t[0].isupper() and len(bare) > 3 and sum(c.isalpha() for c in bare) >= len(bare) - 1
    link = zlib.crc32(bare.encode("utf-8", "replace")) | 1 if capital else 0
    bones = skeleton(bare) if capital else ""
    similar = zlib.crc32(bones.encode("utf-8", "replace")) | 1 if len(bones) > 2 else link
    tail = bare[-3:] if not coded else "@" if "@" in t else f"{t.count('0')}{any(c.isalpha() for c in t)}"
    return zlib.crc32(w.encode("utf-8", "replace")), zlib.crc32(s[:24].encode("utf-8", "replace")), zlib.crc32(tail.encode("utf-8", "replace")), listed, link, similar, int(w in _VERSUS)


def _place(which: int, word: str) -> int:
    return zlib.crc32(f"{which}{word}".encode("utf-8", "replace")) >> (32 - LIST_BITS)


def _listed(names: np.ndarray, which: int, word: str) -> bool:
    k = _place(which, word)
    return bool(names[k >> 3] >> (k & 7) & 1)


def _hash(attr: np.ndarray) -> list[np.ndarray]:
    return [attr[:, k].astype(np.uint64) for k in range(4)]


P = np.uint64(1_000_003)


def own_features(attr: np.ndarray) -> list[np.ndarray]:
    """Buckets by which a token bears on the tokens -SPAN .. SPAN away from itself; (tokens, features) each."""
    low, shape, tail, listed = _hash(attr)
    out = []
    with np.errstate(over="ignore"):
        for o in range(-SPAN, SPAN + 1):
            if o == 0:
                cols = [low, shape, tail, listed * P + shape, listed]
            elif abs(o) == 1:
                cols = [low, shape, listed, tail]
            else:
                cols = [low, shape] if abs(o) == 2 else [low]
            out.append(np.stack([_mix(c, 16 * (o + SPAN) + k + 1) for k, c in enumerate(cols)], 1))
    return out


def _at(a: np.ndarray, k: int) -> np.ndarray:
    """The value k places on; outside, 0."""
    out = np.zeros_like(a)
    if k > 0:
        out[:-k] = a[k:]
    elif k < 0:
        out[-k:] = a[:k]
    else:
        out = a
    return out


def pair_features(attr: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """Buckets of features that join a token with its neighbours. edge: 1 a line starts, 2 a line ends here."""
    low, shape, _, listed = _hash(attr)
    with np.errstate(over="ignore"):
        versus = attr[:, 6].astype(np.int64)
        reach = np.concatenate(([0], np.cumsum(versus)))
        n, at = len(attr), np.arange(len(attr))
        ahead = reach[np.minimum(at + 9, n)] > reach[np.minimum(at + 1, n)]
        behind = reach[at] > reach[np.maximum(at - 8, 0)]
        near = ahead.astype(np.uint64) + np.uint64(2) * behind.astype(np.uint64)
        s1, t1, l1, r1 = _at(shape, -1), _at(shape, 1), _at(low, -1), _at(low, 1)
        left = s1 * P + shape
        right = shape * P + t1
        cols = [left, right, left * P + t1, l1 * P + shape, shape * P + r1, _at(listed, -1) * P + listed, listed * P + _at(listed, 1), edge.astype(np.uint64) * P + shape, near * P + shape, right * P + _at(shape, 2), left * P + _at(shape, -2)]
        return [_mix(c, 128 + k) for k, c in enumerate(cols)]


def skip_edges(doc: np.ndarray, attr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, 2) of linked tokens, each occurrence to the one before in its document, and their kinds.

    Kind: 1 if the spellings differ, plus 2 if just one of the two stands beside a "v.".
    """
    at = np.flatnonzero(attr[:, 5])
    order = at[np.lexsort((at, attr[at, 5], doc[at]))]
    if len(order) < 2:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    same = (doc[order[1:]] == doc[order[:-1]]) & (attr[order[1:], 5] == attr[order[:-1], 5])
    edges = np.stack([order[:-1][same], order[1:][same]], 1)
    reach = np.concatenate(([0], np.cumsum(attr[:, 6])))
    n = len(attr)
    beside = reach[np.minimum(edges + 9, n)] > reach[np.maximum(edges - 8, 0)]
    return edges, (attr[edges[:, 0], 4] != attr[edges[:, 1], 4]) + 2 * (beside[:, 0] != beside[:, 1])


def messages(unary: np.ndarray, chain: np.ndarray, left: np.ndarray, skips: np.ndarray, agree: np.ndarray, rounds: int):
    """Loopy sum-product. left: tokens chained to the next one; agree: (edges, labels) log potential where both ends have a label.

    Returns the beliefs (log, not normed) and for chain edges and skip edges the
    beliefs of both ends without the message over that edge.
    """
    n, k = unary.shape
    c, s = len(left), len(skips)
    src = np.concatenate([left, left + 1, skips[:, 0], skips[:, 1]])
    dst = np.concatenate([left + 1, left, skips[:, 1], skips[:, 0]])
    back = np.concatenate([np.arange(c, 2 * c), np.arange(c), np.arange(2 * c + s, 2 * c + 2 * s), np.arange(2 * c, 2 * c + s)])
    top = chain.max()
    fwd, bwd, diag = np.exp(chain - top), np.exp(chain.T - top), np.exp(np.concatenate([agree, agree])) - 1
    msg = np.zeros((len(src), k), unary.dtype)

    def beliefs():
        out = unary.copy()
        out[left + 1] += msg[:c]
        out[left] += msg[c : 2 * c]
        if s:
            out += np.stack([np.bincount(dst[2 * c :], msg[2 * c :, j], n) for j in range(k)], 1)
        return out

    for r in range(rounds):
        out = beliefs()[src] - msg[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.concatenate([out[:c] @ fwd, out[c : 2 * c] @ bwd, out[2 * c :].sum(1, keepdims=True) + out[2 * c :] * diag])
        new = np.log(new / new.sum(1, keepdims=True) + 1e-12)
        msg = (0.5 * msg + 0.5 * new if s and r else new).astype(unary.dtype)
    b = beliefs()
    return b, (b[left] - msg[c : 2 * c], b[left + 1] - msg[:c]), (b[skips[:, 0]] - msg[2 * c + s :], b[skips[:, 1]] - msg[2 * c : 2 * c + s])


class Breaks(dict):
    """Whether white space ends a line; filled on demand."""

    def __missing__(self, gap: str) -> bool:
        end = "\n" in gap or len(gap) > 2
        if len(gap) < 9:
            self[gap] = end
        return end


class Crf:
    """Fitted potentials. names: bit field of listed names, or None."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray, names: np.ndarray | None = None):
        self.weights, self.chain, self.skip, self.names = weights, chain, skip, names
        self._forget()

    def __getstate__(self):
        return self.weights, self.chain, self.skip, self.names

    def __setstate__(self, s):
        self.__init__(*s)

    def with_names(self, names: np.ndarray | None) -> Crf:
        return Crf(self.weights, self.chain, self.skip, names)

    def _forget(self) -> None:
        """Empty the caches of words and tokens; number 0 is the gap between documents."""
        self.breaks = Breaks()
        self.raw: dict[str, int] = {}
        self.types: dict[str, int] = {}
        self.raw_at, self.raw_n = Grown((), np.int64), Grown((), np.int64)
        self.sub = Grown((3,), np.int64)  # token, start and end in the word
        self.attr, self.own = Grown((7,), np.int64), Grown((2 * SPAN + 1, K), np.float32)
        self._add_types([(1, 1, 1, 0, 0, 0, 0)])

    def _add_types(self, rows: list[tuple]) -> None:
        a = np.array(rows, np.int64)
        self.attr.add(a)
        self.own.add(np.stack([self.weights[f].sum(1) for f in own_features(a)], 1))

    def _learn(self, words: set[str]) -> None:
        at, n, sub, new = [], [], [], []
        for w in words:
            self.raw[w] = self.raw_at.n + len(at)
            at.append(self.sub.n + len(sub))
            for m in TOKEN.finditer(w):
                k = self.types.get(m.group())
                if k is None:
                    k = self.types[m.group()] = self.attr.n + len(new)
                    new.append(attributes(m.group(), self.names))
                sub.append((k, m.start(), m.end()))
            n.append(self.sub.n + len(sub) - at[-1])
        self.raw_at.add(np.array(at))
        self.raw_n.add(np.array(n))
        if sub:
            self.sub.add(np.array(sub))
        if new:
            self._add_types(new)

    def stream(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(type, doc, start, end, edge) of all tokens of the texts, SPAN gaps before and after each text."""
        if len(self.raw) > 250_000:
            self._forget()
        words, gaps, counts = [], [], []
        for t in texts:
            parts = SPLIT.split(t.translate(_FOLD_DIGITS))
            words += parts[::2]
            gaps += parts[1::2]
            gaps.append("\n")
            counts.append(len(parts) // 2 + 1)
        known = self.raw
        fresh = set(words) - known.keys()
        if fresh:
            self._learn(fresh)
        raw = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        size, gap = np.fromiter(map(len, words), np.int64, len(words)), np.fromiter(map(len, gaps), np.int64, len(words))
        broken = np.fromiter(map(self.breaks.__getitem__, gaps), bool, len(words))
        counts = np.array(counts)
        first = np.cumsum(counts) - counts
        ends = np.cumsum(size + gap)
        start = ends - size - gap
        base = start[first]
        starts_line = np.ones(len(words), bool)
        starts_line[1:] = broken[:-1]
        starts_line[first] = True
        n = self.raw_n.a[raw]
        total = n.sum()
        which = np.repeat(np.arange(len(words)), n)
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        sub = self.sub.a[self.raw_at.a[raw][which] + inner]
        owner = np.repeat(np.arange(len(texts)), counts)[which]
        edge = (starts_line[which] & (inner == 0)) + 2 * (broken[which] & (inner == n[which] - 1))
        spot = np.arange(total) + SPAN * (owner + 1)
        whole = total + SPAN * (len(texts) + 1)
        cols = []
        for values in (sub[:, 0], owner, start[which] - base[owner] + sub[:, 1], start[which] - base[owner] + sub[:, 2], edge):
            c = np.zeros(whole, np.int64)
            c[spot] = values
            cols.append(c)
        cols[1][cols[0] == 0] = -1
        return tuple(cols)

    def potentials(self, types: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """(tokens, labels) sums of all features."""
        out = np.zeros((len(types), K), np.float32)
        for o in range(-SPAN, SPAN + 1):  # a token bears on those o away
            rows = self.own.a[types, o + SPAN]
            if o > 0:
                out[o:] += rows[:-o]
            elif o < 0:
                out[:o] += rows[-o:]
            else:
                out += rows
        for f in pair_features(self.attr.a[types], edge):
            out += self.weights[f]
        return out

    def label(self, unary: np.ndarray, types: np.ndarray, doc: np.ndarray, rounds: int = 12) -> np.ndarray:
        """Most likely label of each token."""
        edges, kind = skip_edges(doc, self.attr.a[types])
        chain = self.chain
        gain = np.abs(self.skip[kind]).max(1) if len(edges) else np.zeros(0)
        linked = np.bincount(edges.ravel(), np.repeat(gain * 2, 2), len(types)).astype(np.float32)[:, None] if len(edges) else np.float32(0)
        own = unary - unary[:, :1] + linked
        most = own + ((chain - chain[:, :1]).max(0) + (chain - chain[:1]).max(1)).astype(np.float32)
        ahead, behind = np.exp(chain - chain[O, O]).astype(np.float32), np.exp(chain.T - chain[O, O]).astype(np.float32)
        for _ in range(2):  # a neighbour can support a label by no more than it may have labels itself
            odds = np.exp(np.minimum(most, 30))
            odds[:, O] = 1
            most = own.copy()
            most[1:] += np.log(odds[:-1] @ ahead)
            most[:-1] += np.log(odds[1:] @ behind)
        open_ = (most[:, 1:].max(1) > -SURE) & (types > 0)
        out = np.zeros(len(types), np.int64)
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        number = np.full(len(types), -1)
        number[at] = np.arange(len(at))
        field = unary[at].astype(np.float64)
        settled = (number < 0) & (types > 0)
        field += np.where(settled[at - 1][:, None], chain[0], 0) + np.where(settled[at + 1][:, None], chain[:, 0], 0)
        left = np.flatnonzero(np.diff(at) == 1)
        a, b = number[edges[:, 0]], number[edges[:, 1]]
        for x, y in ((a, b), (b, a)):
            half = (x >= 0) & (y < 0)
            np.add.at(field, (x[half], O), self.skip[kind[half], O])
        both = (a >= 0) & (b >= 0)
        beliefs, _, _ = messages(field, chain, left, np.stack([a[both], b[both]], 1), self.skip[kind[both]], rounds)
        out[at] = beliefs.argmax(1)
        return out

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, end, label) of each case in each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        full = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if not full:
            return out
        types, doc, start, end, edge = self.stream([texts[i] for i in full])
        label = self.label(self.potentials(types, edge), types, doc)
        at = np.flatnonzero(label)
        if not len(at):
            return out
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (label[at][1:] != label[at][:-1])
        begin = np.flatnonzero(new)
        for a, b in zip(at[begin], at[np.append(begin[1:], len(at)) - 1]):
            i, y = full[doc[a]], int(label[a])
            out[i] += [(x, e, y) for x, e in exact(texts[i], int(start[a]), int(end[b]), y)]
        return out


_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)"
_EMAIL = re.compile(rf"[\w.+\-]+(?:{_DOT}[\w+\-]+)*\s?(?:@|[\[(]\s?at\s?[\])])\s?[\w\-]+(?:{_DOT}[\w\-]+)+", re.I)
_IDS = re.compile(r"(?<![\w-])(?:\d{4}(?:[\s\-]{0,2})\d{4}(?:[\s\-]{0,2})\d{4}|[A-Z]{5}\d{4}[A-Z]|[A-Z]{1,3}\d{7}|[A-Z]{2}-?\d{2}[ -]?\d{4}[ -]?\d{7})(?![\w-]|\s?gram)")
_FIRM_WORDS = "charitable|trust|brothers|textiles|pvt|ltd|limited|foundation|associates|industries|university|bank|board|authority|mills|court|traders|builders|enterprises|agencies|foods|steel|hospital|transport|finance|corporation|sugar|company|school|college|society|association|union|co-operative|press|motors|stores"
_FIRM = re.compile(rf"\s*(?:&|and)\s+(?:sons|co)\b|\s*(?:{_FIRM_WORDS})\b", re.I)
_ENDS_AS_FIRM = re.compile(rf"\b(?:{_FIRM_WORDS})$", re.I)
_TITLE = re.compile(r"(?:justice|judge|j\.|m/s\.?|versus|\bvs?\.?)\s*$", re.I)
_PLAIN = frozenset("any every each whoever where an the a no all such this that whether person if when upon in on of for and or by with his her their its".split())
_HONOUR = re.compile(r"^(?:shri|smt|mr|mrs|ms|dr|kum|sri|late|minor|master|pw-?\d+|s/o|d/o|w/o|r/o)\b\.?\s*", re.I)
_WORD = r"[^\W\d_][^\W_]+"
_PERSON = re.compile(rf"(?:[^\W\d_]\.\s*){{1,3}}{_WORD}|{_WORD}(?:-\n[^\W\d_]+)?[,]?\s+(?:[^\W\d_]\.\s*)?{_WORD}(?:-\n[^\W\d_]+)?")


def exact(text: str, a: int, b: int, label: int) -> list[tuple[int, int]]:
    """Spans inside a labelled stretch that have the form of their type."""
    piece = text[a:b]
    if label == EMAIL:
        return [(m.start(), m.end()) for m in _EMAIL.finditer(text, max(0, a - 80), min(len(text), b + 80)) if m.end() > a and m.start() < b]
    if label == PHONE:
        while a > 0 and text[a - 1] in "+(":
            a -= 1
        digits = sum(c.isdigit() for c in text[a:b])
        return [(a, b)] if 10 <= digits <= 14 else []
    if label == IDENTITY:
        return [(m.start(), m.end()) for m in _IDS.finditer(text, max(0, a - 20), min(len(text), b + 20)) if m.end() > a and m.start() < b]
    if label == ADDRESS:
        return [(a, b)] if re.search(r"\d", piece) and re.search(r"[^\W\d_]{3,}", piece) and (piece.count(",") or piece.count(" ") > 1) else []
    got = []
    while (m := _HONOUR.match(text[a:b])) and m.end():
        a += m.end()
    for m in _PERSON.finditer(text, a, b):
        after, before = text[m.end() : m.end() + 24], text[max(0, m.start() - 12) : m.start()]
        if set(re.findall(r"[^\W\d_]{2,}", m.group().lower())) & _PLAIN or _FIRM.match(after) or _ENDS_AS_FIRM.search(m.group()) or re.match(r"\s+(?:v|vs|versus)\b", after, re.I) or _TITLE.search(before):
            continue
        got.append(m.span())
    return got


@lru_cache(maxsize=4)
def train(size: int = 5_500, epochs: int = 6, seed: int = 5, skips: bool = True) -> Crf:
    """Potentials fitted jointly to synthetic documents by the gradient of the loopy likelihood (AdaGrad)."""
    rng = np.random.default_rng(seed)
    maker = synthetic.Maker(seed)
    model = Crf(np.zeros((1 << BITS, K), np.float32), np.zeros((K, K)), np.zeros((4, K)))
    texts, spans, lists = zip(*(maker.document() for _ in range(size)))
    w, g2 = np.zeros((1 << BITS, K), np.float32), np.full((1 << BITS, K), 1e-3, np.float32)
    chain, c2 = np.zeros((K, K)), np.full((K, K), 1e-3)
    skip, s2 = np.zeros((4, K)), np.full((4, K), 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(size)
        for lo in range(0, size, 150):
            rows = order[lo : lo + 150]
            types, doc, start, _, edge = model.stream([texts[i] for i in rows])
            attr = model.attr.a[types].copy()
            y = np.zeros(len(types), np.int64)
            for j, i in enumerate(rows):
                mine = np.flatnonzero(doc == j)
                s = start[mine]
                for a, b, lab in spans[i]:
                    y[mine[np.searchsorted(s, a) : np.searchsorted(s, b)]] = lab
                for a, b, bits in lists[i]:
                    attr[mine[np.searchsorted(s, a) : np.searchsorted(s, b)], 3] = bits
            own = own_features(attr)
            f = np.concatenate([*[np.stack([_at(c, -o) for c in x.T], 1) for o, x in zip(range(-SPAN, SPAN + 1), own)], np.stack(pair_features(attr, edge), 1)], 1)
            unary = w[f].sum(1)
            real = types > 0
            left = np.flatnonzero(real[:-1] & real[1:])
            edges, kind = skip_edges(doc, attr)
            if not skips:
                edges, kind = edges[:0], kind[:0]
            belief, (ca, cb), (sa, sb) = messages(unary.astype(np.float64), chain, left, edges, skip[kind], 8)
            p = np.exp(belief - belief.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            err = (p - np.eye(K)[y]) * real[:, None] / len(rows)
            flat, wide = f[real].ravel(), f.shape[1]
            gw = np.stack([np.bincount(flat, np.repeat(err[real, j], wide), 1 << BITS) for j in range(K)], 1)
            gw += 2e-5 * w * (gw != 0)
            pair = ca[:, :, None] + chain[None] + cb[:, None, :]
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            pair /= pair.sum((1, 2), keepdims=True)
            true = np.zeros((K, K))
            np.add.at(true, (y[left], y[left + 1]), 1)
            gc = (pair.sum(0) - true) / len(rows) + 1e-4 * chain
            if len(edges):
                joint = sa[:, :, None] + sb[:, None, :]
                joint[:, range(K), range(K)] += skip[kind]
                joint = np.exp(joint - joint.max((1, 2), keepdims=True))
                joint /= joint.sum((1, 2), keepdims=True)
                d = joint[:, range(K), range(K)]
                d[np.arange(len(edges)), y[edges[:, 0]]] -= y[edges[:, 0]] == y[edges[:, 1]]
                gs = np.stack([np.bincount(kind, d[:, j], 4) for j in range(K)], 1) / len(rows) + 1e-4 * skip
                s2 += gs * gs
                skip -= 0.3 * gs / np.sqrt(s2)
            g2 += gw * gw
            c2 += gc * gc
            w -= (0.15 * gw / np.sqrt(g2)).astype(np.float32)
            chain -= 0.15 * gc / np.sqrt(c2)
    return Crf(w, chain, skip)


def name_field(parties: DataFrame, columns: list[str]) -> np.ndarray:
    """Bit field of given names and surnames: the two words of party values of the form "Xxxx Yyyy".

    The bits are put together by aggregation into at most 2^24 / 64 rows, so what the driver gets is bounded.
    """
    each = parties.select(F.explode(F.array(*[F.trim(c) for c in columns])).alias("v")).where(r"v rlike '^[A-Z][a-z]{2,} [A-Z][a-z]{2,}$'")
    parts = F.split(F.lower("v"), " ")
    words = each.select(F.explode(F.array(F.concat(F.lit("0"), parts[0]), F.concat(F.lit("1"), parts[1]))).alias("w"))
    place = F.shiftright(F.crc32("w"), 32 - LIST_BITS)
    rows = words.select(F.shiftright(place, 6).cast("int").alias("k"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % f"(crc32(w) >> {32 - LIST_BITS})").alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (LIST_BITS - 6), np.int64)
    for r in rows.toLocalIterator():
        out[r.k] = r.b
    return out.view(np.uint8)


RESULT = "field_name string, pii_types array<string>, n_spans int, redacted string"


def redact(df: DataFrame, row_id: str, fields: list[str], model: Crf, chars: int = 600_000) -> DataFrame:
    """(row_id, field_name, pii_types, n_spans, redacted) of each field value with personal data.

    chars: characters labelled at once, which bounds a task's memory; a text is never cut.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("row_id", df.schema[row_id].dataType), *T._parse_datatype_string(RESULT).fields])

    def run(batches):
        m = shared.value
        for b in batches:
            for j, name in enumerate(fields):
                texts = [t or "" for t in b.column(j + 1).to_pylist()]
                lo = 0
                while lo < len(texts):
                    hi, size = lo + 1, len(texts[lo])
                    while hi < len(texts) and size + len(texts[hi]) <= chars:
                        size += len(texts[hi])
                        hi += 1
                    keep, out = [], []
                    for i, spans in enumerate(m.find(texts[lo:hi]), lo):
                        if not spans:
                            continue
                        t, parts, last, n = texts[i], [], 0, 0
                        for a, e, y in sorted(spans):
                            if a < last:
                                continue
                            parts += [t[last:a], PLACEHOLDER[y]]
                            last, n = e, n + 1
                        keep.append(i)
                        out.append((name, sorted({LABELS[y] for _, _, y in spans}), n, "".join([*parts, t[last:]])))
                    if keep:
                        kinds = (pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=schema.names)
                    lo = hi

    return df.select(F.col(row_id).alias("row_id"), *fields).mapInArrow(run, schema)
