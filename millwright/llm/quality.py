r"""Quality rules by distribution divergence (DataFrame and SQL functions only).

A document's character-class histogram and common-word histogram are compared
with references of each language by the Jensen-Shannon distance (base 2, 0 to
1); the smallest distance over the languages counts, so a wrong language tag
harms nobody.  Nothing is known of a language beforehand: the common words are the most frequent ones of *all* documents
whose ``lang`` names it (at most ``COMMON_PER_LANGUAGE`` of each of the ``LANGUAGES`` with most of them), the references the sums of
all their histograms.  Minimum-length guards keep short texts from being judged on noise.

The word limit comes from the references, for most words of any text are none of the
vocabulary: with 0.81 of them outside, as in the test tables, a text without one common word is only
0.31 away, and no text of the corpus comes to a fixed 0.60.  So a text is odd if its distance
from *every* reference exceeds ``max_word_share`` = 0.95 of the distance that a text without any common
word has from it: such a text (share 1) always goes.  Clean texts stay: of 200,000 random draws from each of
the four references of sf0.01, at most 0.73 % exceed the limit at the guard of 50 words, 0.14 % at 60, 0.003 %
at 80, none at 150 (0.90 would lose 2.7 % at 50).  A reference with fewer than ``LEAST_COMMON`` common
words (a corpus that is mostly junk) is nearer to junk than to clean texts, so it only speaks against
texts with fewer common words than it has itself; one without any says nothing.

Languages without a reference (no tag, a rare tag, one beyond ``LANGUAGES``) must not pay for that.  Such a text, if no reference knows its
words, goes only if it has no common words of its own either: under ``min_own_repeats`` of its words are an earlier one again
(prose of 50 words has 15 % and more, made-up words next to none).  Where letters without case prevail (Chinese, Thai, Arabic)
words by white space say little, so only characters are compared, and only if a reference is of that kind.

All counts are made inside the row; what is shuffled are counts of (language, word) and one row per language
and task, both added up before.

Defined results: a null or empty text has no words and fails the base rule; a
null ``lang`` adds to no reference; if no reference exists (empty table, no language with enough text) only the base rule decides.
Rows are judged one by one, so repeated rows and null ids need no rule.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import SPACE_CLASS, let, stored, text_or_empty, word_list

#: Languages with references, their common words, how often a common word is seen at least, and all of a language together.
LANGUAGES = 12
COMMON_PER_LANGUAGE = 12
LEAST_SEEN = 5
LEAST_SEEN_TOGETHER = 200
#: Longer words are not common.
COMMON_CHARS = 10
# Java patterns of character classes; white space, symbols, letters without case and the rest are four more.
LOWER, UPPER, SPACE, SYMBOL = r"\p{Ll}+", r"\p{Lu}+", rf"[{SPACE_CLASS}]+", r"[#*$%&|<>]+"
CASELESS = r"[\p{Lo}\p{M}]+"
WINDOW = 8
CLASSES = 6
#: Share of common words below which a reference describes no running text (the four languages have 0.18 and more).
LEAST_COMMON = 0.05


@dataclass(frozen=True)
class Rules:
    """Production parameters."""

    min_words: int = 20
    max_repeat_percent: int = 30
    min_chars_judged: int = 200
    min_words_judged: int = 50
    max_char_distance: float = 0.25
    #: Of the distance between a reference and a text without common words.
    max_word_share: float = 0.95
    #: Of the words, in languages without a reference.
    min_own_repeats: float = 0.05


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The most frequent words (letters only, lower case) by language, from one count over all documents.

    What comes to the driver is one row for each of at most LANGUAGES languages.
    """
    told = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.explode(F.split(F.lower(text_or_empty(F.col(text_col))), rf"[{SPACE_CLASS}]+")).alias("word"))
    counts = told.filter(F.length("word").between(1, COMMON_CHARS)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.filter((F.col("n") >= LEAST_SEEN) & F.col("word").rlike(r"^\p{L}+$"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).filter(F.col("place") <= COMMON_PER_LANGUAGE)
    by_language = top.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("word")).alias("words"))
    by_language = by_language.filter(F.col("n") >= LEAST_SEEN_TOGETHER)
    return {r["lang"]: r["words"] for r in by_language.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}


def _covered(hashes: Column) -> Column:
    """Words in 8-word windows found twice or more, from the hashes of the windows in order."""

    def count(order: Column) -> Column:
        same = lambda x, i, k: F.coalesce(F.get(order, i + k)["h"] == x["h"], F.lit(False))
        repeated = F.filter(order, lambda x, i: ((i > 0) & same(x, i, -1)) | same(x, i, 1))
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        walked = F.aggregate(
            starts,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")),
        )
        return walked["n"]

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, count))


def _chained(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on."""
    return let(hashes, lambda a: F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, step + 1, F.size(a) - step), lambda x, y: F.xxhash64(x, y)))


def _repeat_words(word_hashes: Column) -> Column:
    """Window hashes by doubling: 1 to 2 to 4 to 8 words."""
    windows = _chained(_chained(_chained(word_hashes, 1), 2), 4)
    return F.when(F.size(word_hashes) < WINDOW + 1, F.lit(0)).otherwise(let(windows, _covered))


def _slots(vocabulary: list[str]) -> tuple[int, dict[int, tuple[int, str]], list[str]]:
    """A perfect hash of the vocabulary: slots, (word hash, mark) by slot, and the marks.

    Each common word (also capitalised and in capitals) has one character as its mark.
    """
    marks = [chr(40 + k) if k < 80 else chr(0x180 + k) for k in range(len(vocabulary))]
    signed = lambda w: int.from_bytes(xxhash.xxh64_digest(w.encode(), seed=42), "big", signed=True)
    known: dict[int, str] = {}
    for w, m in zip(vocabulary, marks):
        for form in (w, w.capitalize(), w.upper()):
            known.setdefault(signed(form), m)
    n = next(n for n in itertools.count(4096) if len({h % n for h in known}) == len(known))
    return n, {h % n: (h, m) for h, m in known.items()}, marks


def _constant(values: list, kind: str) -> Column:
    return F.split(F.lit(" ".join(map(str, values))), " ").cast(f"array<{kind}>")


def _word_histogram(word_hashes: Column, vocabulary: list[str]) -> Column:
    """Counts of the other words (first) and of each common word.

    The marks of the common words are joined to a string; a word's count is the
    length that its mark takes out of it.
    """
    if not vocabulary:
        return F.array(F.size(word_hashes))
    n, taken, marks = _slots(vocabulary)
    hash_at = _constant([taken.get(k, (0, ""))[0] for k in range(n)], "bigint")
    mark_at = _constant([taken.get(k, (0, "!"))[1] for k in range(n)], "string")
    slot = lambda h: F.pmod(h, F.lit(n)).cast("int")
    spelled = F.array_join(F.transform(word_hashes, lambda h: F.when(F.get(hash_at, slot(h)) == h, F.get(mark_at, slot(h)))), "")
    counts = let(spelled, lambda s: F.array(F.size(word_hashes) - F.length(s), *[F.length(s) - F.length(F.replace(s, F.lit(m), F.lit(""))) for m in marks]))
    return counts


def features(text: Column, vocabulary: list[str], known: Column) -> Column:
    """All counts of a text as one struct; ``known``: whether its language is one of those with common words."""
    t = text_or_empty(text)
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))
    hashed = F.transform(word_list(text), lambda w: F.xxhash64(w))
    by_word = lambda wh: F.struct(
        F.size(wh).alias("n_words"), _word_histogram(wh, vocabulary).alias("words"), _repeat_words(wh).alias("n_repeat_words"),
        F.when(known, F.lit(0)).otherwise(F.size(wh) - F.size(F.array_distinct(wh))).alias("n_again"),
    )
    raw = F.struct(
        let(hashed, by_word).alias("by_word"),
        F.length(t).alias("n_chars"),
        without(SPACE).alias("word_chars"),
        (F.length(t) - without(SYMBOL)).alias("n_symbols"),
        (F.length(t) - without(LOWER)).alias("n_lower"),
        (F.length(t) - without(UPPER)).alias("n_upper"),
        (F.length(t) - without(CASELESS)).alias("n_caseless"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).alias("n_dup_lines"),
    )

    def shaped(q: Column) -> Column:
        space = q["n_chars"] - q["word_chars"]
        rest = q["word_chars"] - q["n_symbols"] - q["n_lower"] - q["n_upper"] - q["n_caseless"]
        return F.struct(
            q["n_chars"].alias("n_chars"), q["by_word"]["n_words"].cast("long").alias("n_words"), q["word_chars"].cast("long").alias("word_chars"),
            q["n_symbols"].cast("long").alias("n_symbols"),
            F.array(q["n_lower"], q["n_upper"], space, q["n_symbols"], q["n_caseless"], rest).alias("chars"), q["by_word"]["words"].alias("words"),
            q["by_word"]["n_again"].alias("n_again"),
            q["n_dup_lines"].cast("long").alias("n_dup_lines"), q["by_word"]["n_repeat_words"].cast("long").alias("n_repeat_words"),
        )

    return let(raw, shaped)


def language_references(counted: DataFrame, languages: list[str], n_common: int) -> dict[str, tuple[list[float], list[float]]]:
    """By language the two reference histograms (sums to 1), over all rows (``lang``, ``f``) of that language.

    What comes to the driver is one row per language, at most LANGUAGES.
    """
    told = counted.filter(F.col("lang").isin(*languages))
    sums = [F.sum(F.col("f.chars")[i]).alias(f"c{i}") for i in range(CLASSES)] + [F.sum(F.col("f.words")[i]).alias(f"w{i}") for i in range(n_common + 1)]
    found = {}
    for r in told.groupBy("lang").agg(*sums).collect() if languages else []:
        chars, words = [float(r[f"c{i}"]) for i in range(CLASSES)], [float(r[f"w{i}"]) for i in range(n_common + 1)]
        if sum(chars) and sum(words):
            found[r["lang"]] = ([x / sum(chars) for x in chars], [x / sum(words) for x in words])
    return dict(sorted(found.items()))


def _each_distance(counts: Column, references: list[list[float]]) -> Column:
    """The Jensen-Shannon distances (base 2) of an array of counts from the references, as an array.

    The divergence is the entropy of the mean less the mean of the entropies; null for an empty text.
    """
    part = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    own = [sum(x * math.log2(x) for x in r if x > 0) for r in references]

    def divergence(shares: Column, entropy: Column, k: int) -> Column:
        means = F.zip_with(shares, F.array(*[F.lit(x) for x in references[k]]), lambda x, y: (x + y) / 2)
        return (entropy + own[k]) / 2 - total(means, part)

    def each(shares: Column) -> Column:
        return let(total(shares, part), lambda e: F.array(*[F.sqrt(F.greatest(F.lit(0.0), divergence(shares, e, k))) for k in range(len(references))]))

    shares = let(total(counts, lambda x: x), lambda n: F.when(n > 0, F.transform(counts, lambda x: x / n)))
    return let(shares, lambda x: F.when(x.isNotNull(), each(x)))


def _distances(counts: Column, references: list[list[float]]) -> Column:
    """The least of ``_each_distance``."""
    return F.array_min(_each_distance(counts, references))


def _without_common(reference: list[float]) -> float:
    """Distance of a reference (the share of other words first) from a text that has other words only."""
    other = reference[0]
    part = lambda x: x * math.log2(x) if x > 0 else 0.0
    divergence = sum(part(x) for x in reference) / 2 - sum(part(x / 2) for x in reference[1:]) - part((1 + other) / 2)
    return math.sqrt(max(0.0, divergence))


def _odd_words(distances: Column, words: Column, n_words: Column, references: list[list[float]], share: float) -> Column:
    """Whether a text is too far from every reference that has common words; null if there is none."""
    odd = []
    for k, reference in enumerate(references):
        common = sum(reference[1:])
        if common <= 0:
            continue
        far = F.get(distances, F.lit(k)) > share * _without_common(reference)
        if common < LEAST_COMMON:
            far = far & (n_words - words[0] < common * n_words)
        odd.append(far)
    return reduce(lambda a, b: a & b, odd) if odd else F.lit(None).cast("boolean")


def _is_caseless(chars: Column) -> Column:
    """Whether letters without case are most of what is not white space."""
    return 2 * chars[4] > F.aggregate(chars, F.lit(0), lambda s, x: s + x) - chars[2]


def judged(f: Column, lang: Column, references: dict, rules: Rules = Rules()) -> Column:
    """Counts, distances and verdict as a struct, from the struct of ``features``."""

    char_references, word_references = [r[0] for r in references.values()], [r[1] for r in references.values()]
    caseless_known = any(2 * r[4] > sum(r) - r[2] for r in char_references)
    none = F.lit(None).cast("array<double>")
    told = F.coalesce(lang.isin(*references), F.lit(False)) if references else F.lit(False)

    def spaceless(r: list[float]) -> list[float]:
        return [x / (sum(r) - r[2]) for k, x in enumerate(r) if k != 2]

    def measured(f: Column) -> Column:
        chars = F.lit(None).cast("double")
        if references:  # without case, white space between words is a matter of taste and is not compared
            inked = F.concat(F.slice(f["chars"], 1, 2), F.slice(f["chars"], 4, CLASSES - 3))
            chars = F.when(_is_caseless(f["chars"]), _distances(inked, [spaceless(r) for r in char_references if sum(r) > r[2]])).otherwise(_distances(f["chars"], char_references))
        return F.struct(f.alias("f"), chars.alias("char_distance"), (_each_distance(f["words"], word_references) if references else none).alias("by_words"), _is_caseless(f["chars"]).alias("caseless"))

    def verdict(q: Column) -> Column:
        f = q["f"]
        failed = (f["n_words"] < rules.min_words) | (100 * f["n_repeat_words"] > rules.max_repeat_percent * f["n_words"])
        comparable = ~q["caseless"] | F.lit(caseless_known)
        odd_chars = (f["n_chars"] >= rules.min_chars_judged) & (q["char_distance"] > rules.max_char_distance) & comparable
        no_reference_knows = _odd_words(q["by_words"], f["words"], f["n_words"], word_references, rules.max_word_share)
        no_own = f["n_again"] < rules.min_own_repeats * f["n_words"]
        odd_words = (f["n_words"] >= rules.min_words_judged) & ~q["caseless"] & no_reference_knows & (told | no_own)
        odd = F.coalesce(odd_chars, F.lit(False)) | F.coalesce(odd_words, F.lit(False))
        return F.struct(
            *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
            failed.alias("base_failed"), (~failed & ~odd).alias("kept"), q["char_distance"].alias("char_distance"), F.array_min(q["by_words"]).alias("word_distance"),
        )

    return let(let(f, measured), verdict)


def quality_rules(docs: DataFrame, carry: list[str], text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """A row per document: ``doc``, a struct of the columns in ``carry``, and ``quality``, the struct of ``judged``.

    The texts are read twice: for the common words, and for the counts, which go to a table in the shared scratch folder
    from which the references are summed and every document is judged.
    """
    common = common_words(docs, text_col, lang_col)
    vocabulary = sorted({w for words in common.values() for w in words})
    known = F.coalesce(F.col(lang_col).isin(*common), F.lit(False)) if common else F.lit(False)
    counted = docs.select(F.struct(*[F.col(c) for c in carry]).alias("doc"), F.col(lang_col).cast("string").alias("lang"), features(F.col(text_col), vocabulary, known).alias("f"))
    counted = stored(counted, "quality-counts")
    references = language_references(counted, list(common), len(vocabulary))
    return counted.select("doc", judged(F.col("f"), F.col("lang"), references, rules).alias("quality"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return quality_rules(docs, docs.columns, text_col, lang_col, rules).filter("quality.kept").select("doc.*")
