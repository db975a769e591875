"""Plain versions of the operators' contracts, for small tables."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, shingle=3):
    ws = words(lower(text or ""))
    if not ws:
        return 0
    pieces = [" ".join(ws[k : k + shingle]) for k in range(max(1, len(ws) - shingle + 1))]
    ones = Counter()
    for p in pieces:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        ones.update(k for k in range(64) if h >> k & 1)
    return sum(1 << k for k, n in ones.items() if 2 * n > len(pieces))


def components(fps, bits=3):
    """Root (place of a fingerprint) of each place."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def component_ids(rows):
    """(id, fp, least id of the component) of rows (id, text)."""
    fps = [fingerprint(t) for _, t in rows]
    root, least = components(fps), {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, fp, least[r]) for (i, _), fp, r in zip(rows, fps, root)]


def passages(rows, n=50):
    """(id, n_words, n_removed, kept) of rows (id, text)."""
    holders = defaultdict(set)
    split = [(i, words(t)) for i, t in rows]
    for i, ws in split:
        if i is not None:
            for k in range(len(ws) - n + 1):
                holders[tuple(ws[k : k + n])].add(i)
    out = []
    for i, ws in split:
        gone = set()
        for k in range(len(ws) - n + 1) if i is not None else ():
            if min(holders[tuple(ws[k : k + n])]) < i:
                gone.update(range(k, k + n))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return out


def lines(rows, min_chars=40, min_docs=5):
    """(id, n_lines, n_dropped, text) of rows (id, text)."""
    key = lambda x: lower(x.strip(SPACE))
    n, keeper = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            n[k] += 1
            keeper[k] = max((x for x in (keeper.get(k), i) if x is not None), default=None)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        gone = [len(key(x)) >= min_chars and n[key(x)] >= min_docs and keeper[key(x)] is not None and i != keeper[key(x)] for x in all_]
        out.append((i, len(all_), sum(gone), "\n".join(x for x, g in zip(all_, gone) if not g)))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws, text = words(text), text or ""
    starts = defaultdict(list)
    for k in range(len(ws) - 7):
        starts[tuple(ws[k : k + 8])].append(k)
    covered = {p for at in starts.values() if len(at) > 1 for k in at for p in range(k, k + 8)}
    real = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(real) - len(set(real)), len(covered)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


AT = ("@", "[at]", "(at)")
DIGIT_STEPS = [(7, "d<7"), (8, "d7"), (10, "d8-9"), (11, "d10"), (12, "d11"), (14, "d12-13"), (16, "d14-15"), (17, "d16"), (10**9, "d17-19")]


def span_features(tokens, i, j):
    """Names of the features that the span tokens[i:j] has."""
    span = tokens[i:j]
    groups = [t for t in span if t[0].isascii() and t[0].isdigit()]
    marks = {t for t in span if not t.isalnum()}
    digits = "".join(groups)
    has = ["bias", next(f for n, f in DIGIT_STEPS if len(digits) < n), f"g{len(groups)}" if 0 < len(groups) < 5 else "g5+" if groups else "alpha"]
    ats = sum(t in AT for t in span)
    if span[0] == "+":
        has.append("plus")
    if "(" in marks and ")" in marks:
        has.append("paren")
    inner = marks - {"+"}
    has += [f for mark, f in (("-", "dash"), (" ", "space"), (".", "dot")) if inner == {mark}]
    if len(inner) > 1:
        has.append("mixed")
    sizes = [len(g) for g in groups]
    if sizes[-2:] == [3, 4]:
        has.append("ends34")
    if sizes == [4, 4, 4, 4]:
        has.append("quads")
    if 13 <= len(digits) <= 19 and luhn(digits):
        has.append("luhn")
    if len(groups) == 4 and len(span) == 7 and inner == {"."} and all(int(g) <= 255 for g in groups):
        has.append("octets")
    if ats == 1:
        has.append("at")
        after = span[next(k for k, t in enumerate(span) if t in AT) + 1 :]
        if "." in after:
            has.append("dotted")
        if after and after[-1].isalpha() and len(after[-1]) >= 2:
            has.append("tld")
    if not ats and any(t.isalpha() for t in span):
        has.append("alpha")
    if ats and " " in marks:
        has.append("spaced")
    if marks - set("+-.() ") and not ats:
        has.append("other")
    left, right = tokens[i - 1] if i else " ", tokens[j] if j < len(tokens) else " "
    has += [f for t, f in ((left, "leftword"), (right, "rightword")) if t.isalnum()]
    has += [f for t, f in ((left, "leftmark"), (right, "rightmark")) if t in "+-_@%." or t in AT]
    if i == 0 or j == len(tokens):
        has.append("edge")
    return set(has)


def span_places(tokens, longest=15, least=7, most=19):
    """(i, j) of the spans that may be entities."""
    n, out = len(tokens), []
    weight = [sum(c in "0123456789" for c in t) for t in tokens]
    for i, first in enumerate(tokens):
        if not (first.isascii() and first.isalnum() or first in "+("):
            continue
        digits = ats = 0
        for j in range(i + 1, min(n, i + longest) + 1):
            last = tokens[j - 1]
            if last == "\n":
                break
            digits += weight[j - 1]
            ats += last in AT
            if ats > 1:
                break
            if last.isascii() and last.isalnum() and (ats or least <= digits <= most) and (ats or weight[j - 1] and (weight[i] or not first.isalpha())):
                out.append((i, j))
    return out
