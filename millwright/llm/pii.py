"""Personal data: base patterns, and more spans from a semi-Markov conditional random field.

*Base.*  Four kinds by pattern and check (parts of an address at most 255, Luhn, number of
digits), leftmost and non-overlapping per kind; a match that fails its check is dropped.
The scans are linear in the text, also on endless runs of digits, and no run is ever turned into a number.

*Semi-Markov CRF.*  A region is a stretch around digits or an at sign, cut into tokens.
Any run of up to ``MAX_TOKENS`` tokens with ``MIN_DIGITS`` to ``MAX_DIGITS`` digits, or one at sign, may be an entity of one
of the four kinds; its score is a weighted sum of features of the whole span (digits, groups, separators, checks, what
stands beside it).  A segmentation scores the sum of its entities, other tokens 0.  The
best one is found by dynamic programming over token places, choosing borders and types
together, with base spans held fixed.  Entities whose score is above ``MARGIN`` are added.

A region can be a whole text (a table of numbers), so it goes through a window of ``WINDOW`` tokens: the features of all
spans that end in it come from running sums over its tokens, and only spans of a positive score are kept.  What is held for a
region is a value and a start for each token.

*Training.*  Weights maximise the conditional likelihood of segmentations on at most ``SAMPLE_REGIONS`` regions, ``PER_TEXT`` of a text
and ``REGION_CHARS`` long at most, of the documents of smallest id hash among those with two digits or
an at sign.  The base spans are the labels; each is also shown in forms that the patterns
miss (a phone number without plus, an address written with [at], a card number with dots).

Scale: detection is a map over the texts with a few hundred weights in the closure; the sample's regions are cut in
the tasks, so the driver gets ``SAMPLE_REGIONS`` short strings whatever the texts are.

Defined results: a null or empty text has no spans; rows are looked at one by one, so
repeated rows and null ids need no rule; an empty sample adds no spans.
"""

from __future__ import annotations

import itertools
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Regions that the weights are fitted on, of a text, their length, documents that are drawn for them, and steps of the fit.
SAMPLE_REGIONS = 400
PER_TEXT = 8
REGION_CHARS = 2000
SAMPLE = 512
STEPS = 40
MAX_TOKENS = 15
WINDOW = 2048
MARGIN = 1.0
#: Characters beside a trigger that belong to its region.
BESIDE = 40

# Fixed by the contract; possessive where the text after the run decides anyway.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    kept = digits.lstrip("0")
    return len(kept) < 3 or len(kept) == 3 and kept <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from its at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, by kind as listed, then start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(map(is_octet, m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# --- regions, segments, features

TOKEN = re.compile(r"\[at\]|\(at\)|[0-9]+|[A-Za-z]+|.", re.S)
TRIGGER = re.compile(r"[0-9](?:[\x20().:/-]{0,2}[0-9])*|@|\[at\]|\(at\)")
AT = ("@", "[at]", "(at)")
MIN_DIGITS = 7
MAX_DIGITS = 19


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around at signs and around runs with digits enough, merged where they meet."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if m[0] in AT or sum(map(str.isdigit, m[0])) >= MIN_DIGITS:
            a, b = max(0, m.start() - BESIDE), min(len(text), m.end() + BESIDE)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [(a, b) for a, b in out]


FEATURES = (
    "bias d<7 d7 d8-9 d10 d11 d12-13 d14-15 d16 d17-19 g1 g2 g3 g4 g5+ plus paren dash space dot mixed ends34 quads luhn octets "
    "at dotted tld alpha spaced other leftword rightword leftmark rightmark edge"
).split()
PLACE = {f: k for k, f in enumerate(FEATURES)}
#: Numbers of digits from which the features "d<7" to "d17-19" hold.
_DIGIT_STEPS = np.array([7, 8, 10, 11, 12, 14, 16, 17])
#: Marks that are told apart, by name; every other token that is neither word nor number is "other" (with at signs apart).
_MARKS = {"+": "plus", "(": "open", ")": "close", "-": "dash", " ": "space", ".": "dot"}


class Spans:
    """The spans of consecutive tokens that may be entities, and their features, by running sums.

    ``before`` and ``after`` are the tokens beside the given ones (None: the region ends there).
    """

    def __init__(self, tokens: list[str], before: str | None = None, after: str | None = None):
        n = len(tokens)
        ascii_ = np.array([t.isascii() for t in tokens], bool)
        digit = np.array([t[0].isdigit() for t in tokens], bool) & ascii_
        word = np.array([t.isalnum() for t in tokens], bool)
        alpha = np.array([t.isalpha() for t in tokens], bool)
        at = np.array([t in AT for t in tokens], bool)
        size = np.array([len(t) for t in tokens], np.int64)
        number = np.where(digit, size, 0)
        upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        marks = {name: upto(np.array([t == c for t in tokens], bool)) for c, name in _MARKS.items()}
        known = np.array([t in _MARKS for t in tokens], bool)
        marks["other"] = upto(~known & ~word)  # an at sign, too
        digits, groups, ats, alphas = upto(number), upto(digit), upto(at), upto(alpha)
        lines = upto(np.array([t == "\n" for t in tokens], bool))
        fours, octets = upto(digit & (size == 4)), upto(np.array([d and is_octet(t) for d, t in zip(digit, tokens)], bool))

        # spans [i, j): every start with every length, kept if they may be an entity
        first = np.flatnonzero(ascii_ & word | np.array([t in "+(" for t in tokens], bool))
        i = np.repeat(first, MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), len(first))
        sound = np.concatenate([[False], ascii_ & word])  # as the last token
        some = (j <= n) & sound[np.minimum(j, n)]
        i, j = i[some], j[some]
        n_digits, n_ats = digits[j] - digits[i], ats[j] - ats[i]
        numeric = (n_digits >= MIN_DIGITS) & (n_digits <= MAX_DIGITS) & digit[j - 1] & (digit[i] | ~alpha[i])
        keep = (lines[j] == lines[i]) & ((n_ats == 1) | (n_ats == 0) & numeric)
        self.i, self.j = i, j = i[keep], j[keep]
        n_digits, n_ats = n_digits[keep], n_ats[keep]
        n_groups = groups[j] - groups[i]
        has = {name: x[j] > x[i] for name, x in marks.items()}
        inner = [has[name] for name in ("open", "close", "dash", "space", "dot")]
        n_other = self._kinds(tokens, ~known & ~word, i, j)
        n_inner = np.sum(inner, axis=0, dtype=np.int64) + n_other

        out = np.zeros((len(i), len(FEATURES)), bool)
        put = lambda name, x: np.logical_or(out[:, PLACE[name]], x, out=out[:, PLACE[name]])
        put("bias", True)
        out[np.arange(len(i)), PLACE["d<7"] + np.searchsorted(_DIGIT_STEPS, n_digits, side="right")] = True
        for k in range(1, 5):
            put(f"g{k}", n_groups == k)
        put("g5+", n_groups >= 5)
        put("alpha", n_groups == 0)
        put("plus", np.array([t == "+" for t in tokens], bool)[i])
        put("paren", has["open"] & has["close"])
        for name in ("dash", "space", "dot"):
            put(name, has[name] & (n_inner == 1))
        put("mixed", n_inner > 1)
        # sizes of the last number up to each token, and of the one before it
        latest = np.maximum.accumulate(np.where(digit, np.arange(n), -1))
        earlier = np.where(latest > 0, np.concatenate([[-1], latest])[latest], -1)
        last_size, earlier_size = (np.where(x >= 0, size[x], 0) for x in (latest, earlier))
        put("ends34", (n_groups >= 2) & (last_size[j - 1] == 4) & (earlier_size[j - 1] == 3))
        put("quads", (n_groups == 4) & (fours[j] - fours[i] == 4))
        put("luhn", (n_digits >= 13) & (n_digits <= MAX_DIGITS) & self._luhn(tokens, digit, digits, i, j))
        put("octets", (n_groups == 4) & (j - i == 7) & has["dot"] & (n_inner == 1) & ~has["plus"] & (octets[j] - octets[i] == 4))
        sign = np.maximum.accumulate(np.where(at, np.arange(n), -1))[j - 1] if n else i
        single = n_ats == 1
        put("at", single)
        put("dotted", single & (marks["dot"][j] > marks["dot"][np.minimum(sign + 1, n)]))
        put("tld", single & (sign < j - 1) & alpha[j - 1] & (size[j - 1] >= 2))
        put("alpha", (n_ats == 0) & (alphas[j] > alphas[i]))
        put("spaced", single & has["space"])
        put("other", ~single & has["other"])
        beside = [" " if before is None else before, *tokens, " " if after is None else after]
        words = np.array([t.isalnum() for t in beside], bool)
        joined = np.array([t in AT or t in "+-_@%." for t in beside], bool)
        put("leftword", words[i]), put("rightword", words[j + 1])
        put("leftmark", joined[i]), put("rightmark", joined[j + 1])
        put("edge", (i == 0) & (before is None) | (j == n) & (after is None))
        self.has = out

    @staticmethod
    def _kinds(tokens: list[str], other: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Different tokens among those marked ``other`` in each span."""
        seen: dict[str, int] = {}
        nearest = np.full(len(tokens), -1)  # where the same token stood before
        for k in np.flatnonzero(other).tolist():
            nearest[k] = seen.get(tokens[k], -1)
            seen[tokens[k]] = k
        out = np.zeros(len(i), np.int64)
        for step in range(MAX_TOKENS):
            at = i + step
            inside = at < j
            at = np.where(inside, at, 0)
            out += inside & other[at] & (nearest[at] < i) if len(other) else 0
        return out

    @staticmethod
    def _luhn(tokens: list[str], digit: np.ndarray, digits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the digits of each span pass the check: two running sums, by which places are doubled."""
        every = np.frombuffer("".join(t for t, d in zip(tokens, digit) if d).encode(), np.uint8).astype(np.int64) - 48
        doubled = np.where(every > 4, 2 * every - 9, 2 * every)
        odd = np.arange(len(every)) % 2 == 1
        sums = [np.concatenate([[0], np.cumsum(np.where(odd == bool(k), every, doubled))]) for k in (0, 1)]
        a, b = digits[i], digits[j]
        plain = (b - 1) % 2  # places of the last digit's parity count once
        total = np.where(plain == 1, sums[1][b] - sums[1][a], sums[0][b] - sums[0][a])
        return total % 10 == 0


class Lattice:
    """Tokens of a short region with all its spans, for the fit."""

    def __init__(self, text: str):
        self.tokens = TOKEN.findall(text)
        self.starts = np.cumsum([0, *map(len, self.tokens)]).tolist()
        spans = Spans(self.tokens)
        self.segments = list(zip(spans.i.tolist(), spans.j.tolist()))
        self.has = spans.has.astype(float)

    def place(self, start: int, end: int) -> tuple[int, int] | None:
        """Token borders of a span of characters; None where a token crosses them."""
        if start in self.starts and end in self.starts:
            return self.starts.index(start), self.starts.index(end)
        return None

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """Probability of each (segment, kind)."""
        n, into, out = len(self.tokens), {}, {}
        total = np.logaddexp.reduce(scores, axis=1)
        for s, (i, j) in enumerate(self.segments):
            into.setdefault(j, []).append((i, s))
            out.setdefault(i, []).append((j, s))
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + total[s] for i, s in into.get(j, ()))])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + total[s] for j, s in out.get(i, ()))])
        rest = np.array([ahead[i] + behind[j] - ahead[n] for i, j in self.segments])
        return np.exp(scores + rest[:, None])


class Best:
    """Best segmentation of tokens that come window by window, by dynamic programming over their ends."""

    def __init__(self):
        self.value = array("d", [0.0])
        self.back: dict[int, tuple[int, int, float]] = {}  # by end: start, kind and score of the entity taken there

    def add(self, n: int, i: np.ndarray, j: np.ndarray, scores: np.ndarray) -> None:
        """``n`` more tokens and the entities (start, end, scores by kind) that end among them."""
        kind = scores.argmax(axis=1) if len(scores) else np.zeros(0, int)
        top = scores.max(axis=1) if len(scores) else np.zeros(0)
        some = top > 0
        order = np.lexsort((i[some], j[some]))
        rows = iter([*zip(j[some][order].tolist(), i[some][order].tolist(), kind[some][order].tolist(), top[some][order].tolist()), (-1, 0, 0, 0.0)])
        end, start, k, score = next(rows)
        value = self.value
        for at in range(len(value), len(value) + n):
            best = value[at - 1]
            while end == at:
                if value[start] + score > best:
                    best, self.back[at] = value[start] + score, (start, k, score)
                end, start, k, score = next(rows)
            value.append(best)

    def found(self) -> list[tuple[int, int, int, float]]:
        """Entities (start, end, kind, score) in order."""
        out, at = [], len(self.value) - 1
        while at:
            if at in self.back:
                start, kind, score = self.back[at]
                out.append((start, at, kind, score))
                at = start
            else:
                at -= 1
        return out[::-1]


# --- training

def _variants(kind: str, span: str) -> list[str]:
    """Other ways to write an entity, which the base patterns miss."""
    if kind == "phone":
        digits = re.findall("[0-9]+", span)
        return [span.lstrip("+"), re.sub(r"^\+[0-9]+[ .-]?", "", span), "-".join(digits), ".".join(digits)]
    if kind == "email":
        return [span.replace("@", "[at]"), span.replace("@", " (at) ")]
    if kind == "card":
        digits = NO_DIGIT.sub("", span)
        quads = [digits[k : k + 4] for k in range(0, len(digits), 4)]
        return ["-".join(quads), " ".join(quads), ".".join(quads)]
    return []


#: What has digits as well but is nobody's: shown in place of an entity, without a label.
NO_ENTITIES = ("2024-01-02, 300", "1,234,567.89", "2023-11-05 12:30:45", "100000000", "31.12.1999, 24 000")


Region = tuple[str, list[Span]]


def _pieces(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """The regions of a text in pieces that are short enough, cut in none of the spans ``base`` (by start) that is no longer itself."""
    for a, b in regions(text):
        while b - a > REGION_CHARS:
            end = a + REGION_CHARS
            for _, s, e in reversed(base):
                if a < s < end < e:
                    end = s
            yield a, end
            a = end
        yield a, b


def labelled(text: str, most: int, cut: bool = False) -> list[Region]:
    """The first ``most`` regions of a text that are short enough, or with ``cut`` pieces of all, with their base spans that overlap no other."""
    base = sorted(base_spans(text), key=lambda x: x[1])
    starts, out = [x[1] for x in base], []
    for a, b in _pieces(text, base) if cut else regions(text):
        if b - a <= REGION_CHARS:
            inside = [(k, s - a, e - a) for k, s, e in base[bisect_left(starts, a) : bisect_left(starts, b)] if e <= b]
            out.append((text[a:b], [x for x in inside if not any(y is not x and y[1] < x[2] and x[1] < y[2] for y in inside)]))
            if len(out) == most:
                break
    return out


def examples(found: list[Region]) -> list[tuple[Lattice, np.ndarray]]:
    """Regions and variants of them with the gold (segment, kind) matrix, at most SAMPLE_REGIONS."""
    out: list[tuple[Lattice, np.ndarray]] = []

    def add(text: str, spans: list[Span]) -> None:
        lattice = Lattice(text)
        gold = np.zeros((len(lattice.segments), len(KINDS)))
        places = {p: s for s, p in enumerate(lattice.segments)}
        for kind, a, b in spans:
            if (p := lattice.place(a, b)) in places:
                gold[places[p], KINDS.index(kind)] = 1
        if len(lattice.segments):
            out.append((lattice, gold))

    for text, spans in found:
        add(text, spans)
        if len(spans) == 1:
            kind, s, e = spans[0]
            for other in _variants(kind, text[s:e]):
                add(text[:s] + other + text[e:], [(kind, s, s + len(other))])
            add(text[:s] + NO_ENTITIES[len(out) % len(NO_ENTITIES)] + text[e:], [])
        if len(out) >= SAMPLE_REGIONS:
            break
    return out[:SAMPLE_REGIONS]


def fit(found: list[Region], decay: float = 0.002) -> np.ndarray:
    """Weights (feature, kind) by gradient ascent (Adam) on the mean log-likelihood."""
    seen = examples(found)
    weights = np.zeros((len(FEATURES), len(KINDS)))
    weights[PLACE["bias"]] = -2.0
    if not seen:
        weights[PLACE["bias"]] = -1e6
        return weights
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        slope = sum(x.has.T @ (gold - x.marginals(x.has @ weights)) for x, gold in seen) / len(seen) - decay * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        weights += 0.5 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def _windows(text: str, a: int, b: int) -> Iterator[tuple[list[str], int, str | None]]:
    """Tokens of text[a:b], ``WINDOW`` at a time: the window, how many of its first tokens were in the last one, and the token behind it."""
    tokens, old = [], 0
    for m in TOKEN.finditer(text, a, b):
        if len(tokens) == old + WINDOW:
            yield tokens, old, m[0]
            old = min(len(tokens), MAX_TOKENS + 1)  # one more, which stands beside the first span
            tokens = tokens[-old:]
        tokens.append(m[0])
    yield tokens, old, None


def _entities(text: str, a: int, b: int, weights: np.ndarray, fixed: tuple[np.ndarray, np.ndarray]) -> Iterator[Span]:
    """What the CRF adds in the region text[a:b]; ``fixed``: starts and ends of stretches that base spans cover, in order."""
    best, starts = Best(), array("q", [a])
    for tokens, old, behind in _windows(text, a, b):
        starts.extend(itertools.accumulate(map(len, tokens[old:]), initial=starts[-1]))
        starts.pop(-1 - len(tokens) + old)  # the first of the new places was there already
        at = len(best.value) - 1 - old  # number of the window's first token
        places = np.frombuffer(starts, np.int64)[at:].copy()
        inner = slice(1, None) if at else slice(None)  # the first token of a later window only stands beside
        spans = Spans(tokens[inner], tokens[0] if at else None, behind)
        i, j = (x + (at > 0) for x in (spans.i, spans.j))
        near = np.searchsorted(fixed[1], places[:-1], side="right")
        covered = near < len(fixed[0])
        covered[covered] = fixed[0][near[covered]] < places[1:][covered]
        upto = np.concatenate([[0], np.cumsum(covered)])
        free = (j > old) & (upto[i] == upto[j])
        best.add(len(tokens) - old, at + i[free], at + j[free], (spans.has[free] @ weights).round(9))  # equal spans score alike in any window
    n = len(best.value) - 1
    for i, j, kind, score in best.found():
        cut = i == 0 and a > 0 or j == n and b < len(text)  # may go on outside the region
        if score > MARGIN and not cut:
            yield KINDS[kind], starts[i], starts[j]


def _union(spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that spans cover."""
    out: list[list[int]] = []
    for _, s, e in sorted(spans, key=lambda x: x[1]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    both = np.array(out, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the entities that the CRF adds."""
    base = base_spans(text)
    more: list[Span] = []
    if DIGIT.search(text) or any(at in text for at in AT):
        fixed = _union(base)
        for a, b in regions(text):
            more += _entities(text, a, b, weights, fixed)
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1]))


def sample_regions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Region]:
    """Labelled regions of the documents of smallest id hash that have two digits in a row or an at sign, at most SAMPLE_REGIONS.

    The documents are counted first, so that only about ``SAMPLE`` of them are looked at again.  Where none of their regions is short
    enough, the regions are cut in pieces.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col)).alias("h"), text.alias("text")).filter(F.col("text").rlike("[0-9][0-9]|@"))
    cut = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * SAMPLE // max(1, rows.count()))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def drawn(pieces: bool) -> list[Region]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(h, k, *r) for h, t in zip(b.column(0).to_pylist(), b.column(1)) for k, r in enumerate(labelled(t.as_py(), PER_TEXT, pieces))]
                columns = list(zip(*found)) or [[]] * 4
                spans = [[{"kind": x, "start": s, "end": e} for x, s, e in each] for each in columns[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns[:3], spans), (pa.int64(), pa.int32(), pa.string(), kind))], ["h", "k", "text", "spans"])

        found = arrow_pass(rows.filter(F.col("h") <= cut), run, "h long, k int, text string, spans array<struct<kind:string,start:long,end:long>>")
        return [(r["text"], [tuple(x) for x in r["spans"]]) for r in found.orderBy("h", "k", "text").limit(SAMPLE_REGIONS).collect()]

    return drawn(False) or drawn(True)


def find_personal_data(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of structs (kind, start, end) in code points, by kind as listed, then start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for b in batches:
            found = [all_spans(t, weights) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([named(x) for x, _ in found], kind), pa.array([named(x) for _, x in found], kind)], ["id", "base", "spans"])

    spans = "array<struct<kind:string,start:long,end:long>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return arrow_pass(rows, run, f"id long, base {spans}, spans {spans}")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_personal_data`` with weights fitted on the sample of ``docs``."""
    return find_personal_data(docs, fit(sample_regions(docs, id_col, text_col)), id_col, text_col)
