"""Training-data operators against plain versions, on edge rows and on the small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from millwright.llm import bpe, linedupe, mixing, packing, pii, quality, queries, sharding, simhash, substring, topk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

_rng = random.Random(5)
PROSE = " ".join(_rng.choice("the of and river stone light walking under seven windows green".split()) + str(_rng.randrange(90)) for _ in range(180))
LINE = "A line that stands in many documents, long enough to count as one."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, h string, doc string, fp string, block string, kept string, known boolean"
#: doc_id, text, lang, source; the other columns have names that operators use inside
ROWS = [
    (1, PROSE, "en", "b"), (2, PROSE, "en", "b"), (3, PROSE + " tail words here", "en", "a"), (4, "head " + PROSE.replace("river", "lake", 2), None, None),
    (5, None, "en", "b"), (6, "", "de", None), (7, " \t\n \r\x0b\x0c", "fr", "c"), (8, "one", "en", "b"), (9, "Two words", "xx", "é"),
    (None, PROSE, "en", "b"), (None, None, None, None), (10, "same row", "en", "b"), (10, "same row", "en", "b"), (10, "other text of the id", "en", "b"),
    *[(20 + k, f"{LINE}\n{' ' * k}{LINE.upper()}\nown line {k}\n", "en", "b") for k in range(6)],
    (30, "ÉÀ é😀 漢字 \n\n x" * 40, "fr", "c"), (31, "w " * 30000, "en", "b"), (32, "a" * 50000, "en", "b"), (33, "1 2-3 " * 2000 + "\n" * 300, "es", "a"),
    (34, "bob.smith@example.com, 10.0.0.255 10.0.0.256 1.2.3.4.5.6.7.8 +1 (663) 555-6869 4532015112830366 45320151 12830366", "en", "a"),
    (35, " ".join(PROSE.split()[20:90]), "en", "a"), (36, "x y z w v u t s " * 12, "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, None if t is None else len(t), "x", "x", None, "d", "f", "b", "k", True) for i, t, lang, s in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


PAIRS = [(i, t) for i, t, _, _ in ROWS]


def test_simhash_edges(docs, none):
    got = Counter((r["id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter(brute.component_ids(PAIRS))
    assert simhash.near_duplicates(none).count() == 0
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    gone = {i for i, _, least in brute.component_ids(PAIRS) if i is not None and i != least}
    want = Counter(i for i, _ in PAIRS if i not in gone)
    want[10] = 2  # the same row only once, the other text of the id is a component of its own
    assert Counter(r["doc_id"] for r in left.collect()) == want


def test_simhash_index_and_regrouping(spark):
    """Dense clusters: groups above the limit are dealt again; components as by comparing all."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:4]:
        for _ in range(120):
            x = centre
            for _ in range(rng.randrange(1, 9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute.components(fps)
    from millwright.llm.components import smallest_reachable

    for group_max in (32, 512):
        root = {r["node"]: r["root"] for r in smallest_reachable(simhash.link_edges(nodes, 3, group_max)).collect()}
        of, same = defaultdict(set), defaultdict(set)
        for x, w in zip(signed, want):
            of[root.get(x, x)].add(x), same[w].add(x)
        assert sorted(map(sorted, of.values())) == sorted(map(sorted, same.values()))


def test_gray_rank_orders_code_words():
    code = np.array([k ^ k >> 1 for k in range(1000)], np.uint64)
    assert (simhash.gray_rank(code) == np.arange(1000)).all()


def test_passages_edges(docs, none):
    got = Counter(tuple(r) for r in substring.dedup_passages(docs).select("id", "n_words", "n_removed", "kept").collect())
    assert got == Counter(brute.passages(PAIRS))
    assert substring.dedup_passages(none).count() == 0


@pytest.mark.parametrize("n", [1, 4, 9, 14, 30, 50, 70])
def test_passages_random(spark, n):
    """Few words, many repeats, all kinds of offsets; short chunks."""
    rng = random.Random(n)
    base = [str(rng.randrange(6)) for _ in range(400)]
    rows = []
    for i in range(25):
        text = []
        for _ in range(rng.randrange(1, 5)):
            a = rng.randrange(300)
            text += base[a : a + rng.randrange(120)] + [f"u{rng.randrange(10**6)}"] * rng.randrange(3)
        rows.append((i // 2 if i % 7 == 0 else i, " ".join(text)))
    rows.append((99, "z " * 300))
    rows.append((98, "z " * 200))
    got = Counter(tuple(r) for r in substring.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=n).select("id", "n_words", "n_removed", "kept").collect())
    assert got == Counter(brute.passages(rows, n))


def test_difference_covers():
    for v, d in substring.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


def test_lines_edges(docs, none):
    out = linedupe.dedup_lines(docs)
    assert out.select("doc.*").columns == docs.columns
    got = Counter((r["doc"]["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["doc"]["text"] or "") for r in out.collect())
    assert got == Counter(brute.lines(PAIRS)) and sum(x[2] for x in got) > 0
    assert linedupe.dedup_lines(none).count() == 0
    few = Counter((r["doc"]["doc_id"], r["lines"]["n_dropped"], r["doc"]["text"] or "") for r in linedupe.dedup_lines(docs, min_chars=4, min_docs=2, batches=5, fanout=2).collect())
    assert few == Counter((a, c, d) for a, _, c, d in brute.lines(PAIRS, 4, 2))


def test_line_runs_compact(docs):
    from pyspark.sql import functions as F

    runs = linedupe.line_runs(docs.select(F.col("doc_id").alias("id"), "text"), 4, batches=5, fanout=2)
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # five batches, two by two
    known = runs.known()
    assert known.count() == known.distinct().count()


def test_line_runs_are_read_as_sorted(spark, docs):
    """Merging and judging runs moves and sorts no rows."""
    from pyspark.sql import functions as F

    runs = linedupe.line_runs(docs.select(F.col("doc_id").alias("id"), "text"), 4, batches=3)
    a, b = runs.levels[0][:2]
    new = runs.read(a).join(runs.read(b).hint("merge"), ["k1", "k2"], "left_anti")
    for df, joins in ((runs._pair(a, b), 1), (new, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == joins and "Exchange" not in plan and "Sort [" not in plan


def test_line_runs_of_a_later_session(spark, docs):
    from pyspark.sql import functions as F

    whole = docs.select(F.col("doc_id").alias("id"), "text")
    part = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    first = linedupe.line_runs(whole.filter(part), 4, batches=3, fanout=2)
    other = spark.newSession()
    later, rival = linedupe.LineRuns.open(other, first.folder), linedupe.LineRuns.open(other, first.folder)
    assert later.levels == first.levels and later.version == 3
    rest = other.createDataFrame(whole.filter(~part).collect(), whole.schema)
    more = linedupe.one_batch(linedupe.batch_keys(rest, 4), 0)
    later.add(more)
    with pytest.raises(Exception, match="(?i)exists"):
        rival.add(more)
    together = linedupe.line_runs(whole, 4, batches=1)
    rows = lambda runs: Counter(tuple(r) for r in runs.verdicts(2).collect())
    assert rows(linedupe.LineRuns.open(spark, first.folder)) == rows(together) and rows(together)


def test_simhash_keeps_the_unique_text_of_a_repeated_id(spark):
    other = " ".join(f"own{k} word{k * 7 % 90}" for k in range(120))
    rows = [(1, PROSE), (5, PROSE), (5, other), (5, other), (6, None), (7, PROSE), (7, ""), (None, other)]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    # the copies of 1 go, also where their id has a text of its own; the empty text of 7 is a copy of 6
    assert Counter(map(tuple, left.collect())) == Counter([(1, PROSE), (5, other), (6, None), (None, other)])
    # whole copies and near copies under one id: one row of each group
    rows = [(1, PROSE, "a"), (1, PROSE, "b"), (1, PROSE, "c"), (2, PROSE, "d"), (3, other, "e"), (3, other + " z", "f"), (4, other, "g")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _n_key string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3] and left.columns == ["doc_id", "text", "_n_key"]


def test_quality_edges(docs, none):
    out = quality.quality_rules(docs, ["doc_id", "text"]).collect()
    for r in out:
        q = r["quality"]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == brute.quality_counts(r["doc"]["text"])
        assert q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"])
        assert not (q["base_failed"] and q["kept"])
    assert len(out) == len(ROWS)
    assert quality.quality_rules(none, ["doc_id"]).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_quality_distance_by_definition(spark):
    from pyspark.sql import functions as F

    p, refs = [3, 0, 5, 2], [[0.1, 0.2, 0.3, 0.4], [0.3, 0.0, 0.5, 0.2]]
    row = spark.createDataFrame([(p,), ([0, 0, 0, 0],)], "c array<int>")
    got = [r[0] for r in row.select(quality._distances(F.col("c"), [refs[0]])).collect()]

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt((kl(p) + kl(q)) / 2)

    assert got[0] == pytest.approx(js([x / 10 for x in p], refs[0])) and got[1] is None
    assert row.select(quality._distances(F.col("c"), refs)).first()[0] == pytest.approx(0, abs=1e-7)


def test_quality_tells_junk(spark, sf):
    out = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id", "text"]).collect()
    for r in out:
        odd = sum(c in "#*$%&" for c in r["doc"]["text"]) > 0.2 * len(r["doc"]["text"])
        if len(r["doc"]["text"]) >= 200:
            assert not (odd and r["quality"]["kept"])
    assert sum(r["quality"]["kept"] for r in out) > 0.8 * len(out)


COMMON_WORDS = {
    "en": "the of and to in a is that it was for on".split(),
    "de": "der die und in den von zu das mit sich des auf".split(),
    "fr": "de la le et les des en un du une que est".split(),
    "es": "de la que el en y los se del las un por".split(),
}
POLISH = """Dawno temu w małym domu na skraju lasu mieszkał stary młynarz i jego córka. Każdego ranka szedł on do młyna, a ona szła z nim i niosła chleb. W młynie było
ciemno, ale na dworze słońce stało już wysoko i ptaki śpiewały w lesie. Młynarz nie mówił wiele, bo nie było o czym mówić, a córka nie pytała. Pewnego dnia przyszedł do nich
człowiek z miasta i powiedział, że młyn jest na sprzedaż, że dom jest na sprzedaż i że w mieście nikt już nie czeka na mąkę. Młynarz nie odpowiedział, tylko wziął chleb i poszedł do lasu."""
RUSSIAN = """Давным-давно в маленьком доме на краю леса жил старый мельник и его дочь. Каждое утро он шёл на мельницу, а она шла с ним и несла хлеб. На мельнице было темно,
но на дворе солнце стояло уже высоко и птицы пели в лесу. Мельник не говорил много, потому что не о чем было говорить, а дочь не спрашивала. Однажды к ним пришёл человек из города и сказал,
что мельница продаётся, что дом продаётся и что в городе никто уже не ждёт муки. Мельник не ответил, только взял хлеб и пошёл в лес."""
CHINESE = "从前 在 森林 边上 的 一 间 小 屋 里 住 着 一位 老 磨坊主 和 他 的 女儿 。 每天 早上 他 都 去 磨坊 ， 她 跟 着 他 ， 带 着 面包 。 磨坊 里 很 暗 ， 但是 外面 太阳 已经 很 高 了 ， 鸟儿 在 森林 里 唱歌 。 有 一天 从 城里 来 了 一个 人 ， 说 磨坊 要 卖 了 ， 房子 也 要 卖 了 。"
CHINESE_LINES = "\n".join(f"第{k}章从前在森林边上的小屋里住着老磨坊主和他的女儿每天早上他去磨坊" + "天地玄黄宇宙洪荒日月盈昃辰宿列张"[k % 16] for k in range(60))
HINDI = "बहुत समय पहले जंगल के किनारे एक छोटे से घर में एक बूढ़ा चक्कीवाला और उसकी बेटी रहते थे । हर सुबह वह चक्की पर जाता था और वह उसके साथ जाती थी और रोटी ले जाती थी । चक्की में अँधेरा था लेकिन बाहर सूरज ऊपर था और पक्षी जंगल में गाते थे । एक दिन शहर से एक आदमी आया और उसने कहा कि चक्की बिकाऊ है और घर बिकाऊ है ।"


def test_quality_keeps_other_languages(spark):
    """Clean texts of languages with no or little text in the corpus stay, tagged, mistagged as unknown or untagged; junk still goes."""
    rng = random.Random(12)
    made = lambda n: ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    prose = lambda lang, n: " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.2 else w for w in made(n))
    rows = [(k, prose(lang, 400), lang, True) for k, lang in enumerate(["en", "de", "fr", "es"] * 10)]
    for k, (text, lang) in enumerate([(POLISH, "pl"), (RUSSIAN, "ru"), (CHINESE, "zh"), (CHINESE_LINES, "zh"), (HINDI, "hi")]):
        rows += [(100 + 10 * k + j, text, tag, True) for j, tag in enumerate([lang, None, "und"])]
    symbols = lambda n: " ".join("".join(rng.choice("#*$%&|<>") for _ in range(6)) for _ in range(n))
    rows += [(200, " ".join(made(120)), None, False), (201, " ".join(made(120)), "xx", False), (202, symbols(90), None, False), (203, symbols(90), "zh", False)]
    schema = "doc_id long, text string, lang string, stays boolean"
    out = quality.quality_rules(spark.createDataFrame(rows, schema), ["doc_id", "stays"]).collect()
    assert {r["doc"]["doc_id"]: r["quality"]["kept"] for r in out} == {i: stays for i, _, _, stays in rows}
    # with enough text of their own they have references, with words of their own
    many = rows + [(1000 + k, text, lang, True) for k in range(40) for text, lang in ((POLISH, "pl"), (RUSSIAN, "ru"), (CHINESE, "zh"))]
    table = spark.createDataFrame(many, schema)
    assert {"i", "nie", "na"} <= set(quality.common_words(table)["pl"]) and {"и", "не"} <= set(quality.common_words(table)["ru"])
    out = quality.quality_rules(table, ["doc_id", "stays"]).collect()
    assert all(r["quality"]["kept"] == r["doc"]["stays"] for r in out)


def test_quality_verdict_by_definition(spark, sf):
    """base_failed and kept of every document from histograms made here."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    common = quality.common_words(docs)
    seen = defaultdict(Counter)
    for r in rows:
        seen[r["lang"]].update(w.lower() for w in brute.words(r["text"]) if len(w) <= 10)
    for lang, words in common.items():
        told = sorted(((-n, w) for w, n in seen[lang].items() if n >= 5 and w.isalpha()))[:12]
        assert sorted(w for _, w in told) == words
    vocabulary = sorted({w for ws in common.values() for w in ws})
    forms = {f: k for k, w in reversed(list(enumerate(vocabulary))) for f in (w, w.capitalize(), w.upper())}

    def histograms(text):
        import unicodedata

        chars, words = [0] * 6, [0] * (len(vocabulary) + 1)
        for c in text:
            kind = unicodedata.category(c)
            chars[0 if kind == "Ll" else 1 if kind == "Lu" else 2 if c in brute.SPACE else 3 if c in "#*$%&|<>" else 4 if kind == "Lo" or kind[0] == "M" else 5] += 1
        for w in brute.words(text):
            words[forms.get(w, -1) + 1] += 1
        return chars, words

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    share = lambda x: [v / sum(x) for v in x]
    own = {r["doc_id"]: histograms(r["text"]) for r in rows}
    sums = {lang: [[sum(own[r["doc_id"]][k][i] for r in rows if r["lang"] == lang) for i in range(n)] for k, n in ((0, 6), (1, len(vocabulary) + 1))] for lang in common}
    references = [(share(a), share(b)) for a, b in sums.values()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_quality_rules"](spark, sf).collect()}
    for r in rows:
        n, _, _, _, repeat = brute.quality_counts(r["text"])
        chars, words = own[r["doc_id"]]
        failed = n < 20 or 100 * repeat > 30 * n
        odd = len(r["text"]) >= 200 and min(js(share(chars), c) for c, _ in references) > 0.25
        if n >= 50 and r["lang"] in common:
            none = [1.0] + [0.0] * len(vocabulary)
            odd = odd or all(js(share(words), w) > 0.95 * js(none, w) for _, w in references)
        assert (got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["kept"]) == (failed, not failed and not odd), r["doc_id"]


def test_quality_rejects_texts_without_common_words(spark):
    rng = random.Random(11)
    made = lambda n: ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(4, 9))) for _ in range(n)]
    prose = lambda lang, n: " ".join(rng.choice(COMMON_WORDS[lang]) if rng.random() < 0.2 else w for w in made(n))
    rows = [(k, prose(lang, 400), lang, True) for k, lang in enumerate(["en", "de", "fr", "es"] * 10)]
    rows += [(100, " ".join(made(120)), "en", False), (101, " ".join(made(900)), None, False), (102, " ".join(made(50)), "de", False)]
    rows += [(200, " ".join(made(49)), "en", True), (201, prose("fr", 300), "en", True), (202, prose("es", 150), "xx", True)]  # below the guard; wrong tags
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, stays boolean")
    out = quality.quality_rules(table, ["doc_id", "stays"]).collect()
    assert {r["doc"]["doc_id"]: r["quality"]["kept"] for r in out} == {i: stays for i, _, _, stays in rows}
    # references that are mostly junk: junk still goes, clean texts still stay
    junk = [(300 + k, " ".join(made(40000)), "en", False) for k in range(3)]
    table = spark.createDataFrame([(r[0], r[1], "en", r[3]) for r in rows if r[0] < 40 and r[2] == "en"] + junk + [(400, " ".join(made(80)), None, False)], table.schema)
    out = quality.quality_rules(table, ["doc_id", "stays"]).collect()
    assert all(r["quality"]["kept"] == r["doc"]["stays"] for r in out)
    # no common word at all: nothing to judge by
    out = quality.quality_rules(spark.createDataFrame([(1, " ".join(made(80)), "en", True)], table.schema), ["doc_id"]).collect()
    assert out[0]["quality"]["kept"]


def test_pii_base_random():
    rng = random.Random(3)
    for _ in range(5000):
        s = "".join(rng.choice("0123456789+.-() @ab0123..  -") for _ in range(rng.randrange(40)))
        assert pii.base_spans(s) == brute.base_spans(s)


def test_pii_edges(docs, none):
    got = {(r["id"], tuple(map(tuple, r["base"]))) for r in pii.personal_data(docs).collect()}
    assert got == {(i, tuple(brute.base_spans(t or ""))) for i, t in PAIRS}
    assert pii.personal_data(none).count() == 0


def test_pii_crf_learns_forms_that_the_patterns_miss(spark, sf):
    weights = pii.fit(pii.sample_regions(spark.read.parquet(f"{sf}/../sf0.1/documents.parquet"), "doc_id", "text"))
    base, spans = pii.all_spans("call (663) 555-6869 now, mail bob.smith[at]example.com today", weights)
    assert base == [] and [k for k, _, _ in spans] == ["email", "phone"]
    assert pii.all_spans("order 12 of 2024-01-02, 300 pieces at 19.95", weights)[1] == []
    held_out = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in held_out:  # base spans stay, added ones overlap none of them
        base, spans = pii.all_spans(t, weights)
        added = [x for x in spans if x not in base]
        assert all(x in spans for x in base) and not any(a[1] < b[2] and b[1] < a[2] for a in added for b in base)


def test_semi_crf_by_enumeration():
    """Marginals and the best segmentation, against all segmentations of a short region."""
    lattice = pii.Lattice("a+1 555-6869 b@c.de")
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(len(lattice.segments), len(pii.KINDS)))
    n = len(lattice.tokens)

    def all_from(i):
        if i == n:
            return [()]
        out = all_from(i + 1)
        for s, (a, b) in enumerate(lattice.segments):
            if a == i:
                out = out + [((s, k), *rest) for rest in all_from(b) for k in range(len(pii.KINDS))]
        return out

    every = all_from(0)
    weight = np.array([sum(scores[s, k] for s, k in x) for x in every])
    p = np.exp(weight - np.logaddexp.reduce(weight))
    want = np.zeros_like(scores)
    for x, q in zip(every, p):
        for s, k in x:
            want[s, k] += q
    assert np.allclose(lattice.marginals(scores), want)
    best, places = pii.Best(), np.array(lattice.segments)
    best.add(n, places[:, 0], places[:, 1], scores)
    assert sum(x[3] for x in best.found()) == pytest.approx(weight.max())


SCRAPS = ["0", "12", "345", "4444", "1.", "(", ")", "-", " ", "+", "@", "[at]", "(at)", "ab", "x", "é", "_", "\n", ".", "/", "com", "255", "\u0663"]


def test_span_features_by_hand():
    rng = random.Random(2)
    for _ in range(600):
        text = "".join(rng.choice(SCRAPS) for _ in range(rng.randrange(1, 40)))
        lattice = pii.Lattice(text)
        assert sorted(lattice.segments) == sorted(brute.span_places(lattice.tokens))
        for (i, j), row in zip(lattice.segments, lattice.has):
            assert {pii.FEATURES[k] for k in np.flatnonzero(row)} == brute.span_features(lattice.tokens, i, j)


def test_pii_windows_change_nothing(monkeypatch):
    rng, values = random.Random(4), np.random.default_rng(1)
    for _ in range(150):
        text = "".join(rng.choice([*SCRAPS, " word" * 9]) for _ in range(rng.randrange(1, 150)))
        weights = values.normal(size=(len(pii.FEATURES), 4))
        monkeypatch.setattr(pii, "WINDOW", 1 << 20)
        want = pii.all_spans(text, weights)
        for window in (1, 7, 16, 40):
            monkeypatch.setattr(pii, "WINDOW", window)
            assert pii.all_spans(text, weights) == want
        added = [x for x in want[1] if x not in want[0]]
        assert not any(a[1] < b[2] and b[1] < a[2] for a in added for b in want[0])


@pytest.mark.parametrize("n", [1, 3, 4301, 100000])
def test_pii_long_digit_runs(n):
    weights = np.ones((len(pii.FEATURES), 4))
    for digit, found in (("0", True), ("9", n == 1)):
        for text in (f"x {digit * n}.1.2.3 y", f"1.2.3.{digit * n}"):
            base, spans = pii.all_spans(text, weights)
            assert [k for k, _, _ in base if k == "ip"] == ["ip"] * found and set(base) <= set(spans)
    assert pii.is_octet("0" * n + "255") and not pii.is_octet("0" * n + "256") and not pii.is_octet("1" + "0" * (n + 2))


def test_pii_very_long_texts():
    """A megabyte of numbers is one region; what it needs beside the text grows with the window."""
    import time
    import tracemalloc

    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10 ** rng.randrange(1, 9))) for _ in range(220000))[:1000000]
    weights = np.random.default_rng(1).normal(size=(len(pii.FEATURES), 4)) - 1
    start = time.process_time()
    pii.all_spans(text, weights)
    assert time.process_time() - start < 10
    tracemalloc.start()
    pii.all_spans(text[:300000], weights)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_pii_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k, "mail a.b@c.de or call +1 663 555 6869, " * 500) for k in range(60)] + [(99, "1234567 " * 100000)], "doc_id long, text string")
    found = pii.sample_regions(docs)
    assert 0 < len(found) <= pii.SAMPLE_REGIONS and max(len(t) for t, _ in found) <= pii.REGION_CHARS
    assert pii.sample_regions(docs.limit(0)) == []


def test_shards_edges(docs, none):
    rows = sharding.shard(docs).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in PAIRS)
    places = defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    assert sharding.shard(none).count() == 0


def test_shards_of_repeated_ids_and_rows(spark):
    """A third of the rows under one id and a third equal in id and text: law ``bytes`` holds all the same."""
    rng = random.Random(3)
    rows = [(7, f"text {k} " + "x" * rng.randrange(300)) for k in range(3000)] + [(8, "the same row " * 12)] * 3000
    rows += [(100 + k, "y" * rng.randrange(300)) for k in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    loads, places = Counter(), defaultdict(list)
    for r in out:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["place"])
    assert Counter((r["id"], r["size"]) for r in out) == Counter((i, len(t) + 1) for i, t in rows)
    assert len(loads) == 16 and max(loads.values()) < 1.03 * min(loads.values())
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    per_slot = Counter(r["vslot"] for r in out)
    assert max(per_slot.values()) < 20


def test_shards_near_equal_and_rebalanced(spark, sf):
    records = sharding.measured(spark.read.parquet(f"{sf}/documents.parquet"))
    first = sharding.slot_map(sharding.slot_sizes(records))
    loads = lambda m: {r["shard"]: r["b"] for r in m.groupBy("shard").agg({"bytes": "sum"}).withColumnRenamed("sum(bytes)", "b").collect()}
    largest = max(r["bytes"] for r in first.collect())
    assert max(loads(first).values()) - min(loads(first).values()) <= largest
    second = sharding.rebalance(first, 17, 2)
    a, b = ({r["vslot"]: (r["shard"], r["bytes"]) for r in m.collect()} for m in (first, second))
    assert a.keys() == b.keys() and set(loads(second)) == set(range(17))
    moved = sum(a[v][1] for v in a if a[v][0] != b[v][0])
    assert moved < 0.2 * sum(x for _, x in a.values())  # a share of one in seventeen, and a little for balance
    third = sharding.rebalance(second, 12, 3)
    assert set(loads(third)) == set(range(12)) and {r["version"] for r in third.collect()} == {3}
    assert sharding.placed(records, third).count() == records.count()


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(3)], "x") for k in range(150)]
    rows += [(150, [0.5, None, 0.1], "x"), (200, [nan, 0.0, 0.0], "x"), (201, [inf, 0.0, 0.0], "x"), (250, None, "x"), (300, [], "x"), (None, [1.0, 1.0, 1.0], "x"),
             (350, [1.0, 2.0], "x"), (351, [1.5, 2.5], "x"), (0, rows[0][1], "x"), (400, [0.0, 0.0, 0.0, 0.0], "x"), (500, [2.0**20, 0.0, 0.0], "x"), (501, [-(2.0**30), 3.0, 2.0**-9], "x"),
             (503, [2.0**21, 2.0**21, -(2.0**21)], "x"), (504, [0.25, 2.0**26, 0.5], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string").repartition(4)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()}
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in ok:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:5]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    assert topk.top_k(df.limit(0), df.limit(0), 5).count() == 0


def test_topk_components_of_any_size(spark):
    """Scores that fit are exact, whatever the components; one among the best that does not fit is an error."""
    rng = random.Random(9)
    big = lambda: rng.choice([0.0, 1.0, -1.0, 2.0**20, 2.0**30, -(2.0**30), 2.0**52 + 1, 3e60, -3e60, 1e300])
    rows = [(0, [1.0, 1.0, 0.0, 0.0, 0.0]), (50, [2.0**20, -0.5, 0.0, 0.0, 0.0]), (100, [2.0**22, -(2.0**22), 0.0, 0.0, 0.0]), (150, [0.0, 0.0, 0.0, 0.0, 1e-300])]
    rows += [(k, [rng.choice([-1, 1]) * 2.0 ** rng.randrange(-9, 20), rng.choice([-1, 1]) * 2.0 ** rng.randrange(0, 22), *(big() for _ in range(3))]) for k in range(201, 250)]
    rows += [(k, [-2.0**20, -2.0**20, big(), 0.0, 0.0]) for k in range(251, 260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    exact = lambda x: math.floor(256 * Fraction(x))
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 50 = 0 and vec_id <= 100"), 5).collect()}
    ok, want = [(i, list(map(exact, v))) for i, v in rows], {}
    for q, v in ok[:3]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want
    over = spark.createDataFrame([(0, [1e30]), (1, [1.0]), (2, [-1.0])], df.schema)
    with pytest.raises(Exception, match="Overflow"):
        topk.top_k(over, over.filter("vec_id = 0"), 1).collect()


def test_topk_small_blocks(spark, sf, monkeypatch):
    """Many blocks and groups give what one block gives."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect())
    for name, value in (("BLOCK_ROWS", 70), ("QUERY_ROWS", 3), ("GROUP_BLOCKS", 2), ("QUERY_BLOCKS", 2)):
        monkeypatch.setattr(topk, name, value)
    assert sorted(topk.top_k(df, df.filter("vec_id % 50 = 0"), 5).collect()) == want


def test_mix_targets():
    sizes = [100, 1000, 1000, 10, 0]
    targets = mixing.shared_targets(sizes)
    assert sum(targets) == Fraction(sum(sizes) * 3, 2) and all(t <= 2 * s for t, s in zip(targets, sizes))
    free = [(t / w) for t, s, w in zip(targets, sizes, (5, 2, 1, 5, 2)) if t < 2 * s]
    assert len(set(free)) <= 1  # those below their bound share by weight
    assert mixing.shared_targets([]) == [] and mixing.shared_targets([0, 0]) == [0, 0]


def test_mix_quotas():
    draws = [1000, 17, 0, 3, 250]
    q = mixing.split_quotas(draws, 16, 3)
    assert q.sum(axis=1).tolist() == draws and q.sum(axis=0).max() - q.sum(axis=0).min() <= 1 and (q >= 0).all()
    assert (q == mixing.split_quotas(draws, 16, 3)).all() and mixing.split_quotas([], 4, 1).shape == (0, 4)


def test_mix_edges(docs, none):
    rows = mixing.drawn(docs, ["doc_id", "text", "source"]).collect()
    assert len(rows) == len(ROWS)
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        n = len(brute.words(r["doc"]["text"]))
        assert r["size"] == n and len(r["draws"]) <= 2
        taken[r["doc"]["source"]] += n * len(r["draws"])
        size[r["doc"]["source"]] += n
        target[r["doc"]["source"]] = (r["source_size"], r["target"])
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = mixing.shared_targets([size[s] for s in order])
    for s, t in zip(order, want):
        assert target[s] == (size[s], pytest.approx(float(t)))
    assert mixing.drawn(none, ["doc_id"]).count() == 0 and mixing.mixed(none).columns == none.columns


def test_mix_near_targets_and_reruns(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    one = mixing.drawn(docs, ["doc_id", "source"]).collect()
    two = mixing.drawn(docs.repartition(7), ["doc_id", "source"]).collect()
    key = lambda r: r["doc"]["doc_id"]
    assert sorted(one, key=key) == sorted(two, key=key)
    taken, target = Counter(), {}
    for r in one:
        taken[r["doc"]["source"]] += r["size"] * len(r["draws"])
        target[r["doc"]["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.005 * t for s, t in target.items())


def test_mix_many_sources(spark):
    """Thousands of sources of a few rows each, one with a third of all rows."""
    rng = random.Random(5)
    rows = [(k, "w " * rng.randrange(1, 30), f"s{k % 2000:05d}" if k % 3 else "hot") for k in range(9000)]
    out = mixing.drawn(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"]).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in out:
        s = r["doc"]["source"]
        taken[s] += r["size"] * len(r["draws"])
        target[s] = r["target"]
        largest[s] = max(largest[s], r["size"])
        assert len(r["draws"]) <= 2
    assert len(target) > 1900 and all(abs(taken[s] - t) <= largest[s] for s, t in target.items())


def test_mix_targets_on_a_table(spark):
    """Numbers, targets and whole epochs of a table of sources against exact fractions, for small and very large sums."""
    rng = random.Random(8)
    for top, percent in ((30, 150), (10**13, 150), (10**13, 230), (5, 0)):
        sizes = [rng.randrange(top) if rng.random() < 0.8 else 0 for _ in range(400)] + [top * 900]
        names = [f"s{rng.random()}é" if k % 3 else f"\U0001F600{k}" for k in range(400)] + [None]
        mix = mixing.Mix(percent=percent)
        table = spark.createDataFrame(list(zip(names, [1000] * 401, sizes)), "source string, n long, words long")
        got = sorted(mixing._with_targets(mixing._numbered(table), mix).collect())
        order = sorted(zip(names, sizes), key=lambda r: (r[0] is None, r[0] or ""))
        assert [(r["s"], r["source"], r["source_size"], r["n_blocks"]) for r in got] == [(k, n, w, 2) for k, (n, w) in enumerate(order)]
        for r, t in zip(got, mixing.shared_targets([w for _, w in order], mix)):
            whole = t // r["source_size"] if r["source_size"] else 0
            assert r["whole"] == whole and r["target"] == pytest.approx(float(t), rel=1e-12)
            assert r["rest"] == pytest.approx(float(t - whole * r["source_size"]), rel=1e-12)


def test_mix_groups_and_stretches(spark, monkeypatch):
    """Groups of a few sources and short stretches: shards stay equal, draws whole, and each source near its target."""
    rng = random.Random(11)
    rows = [(k, "w " * rng.randrange(1, 9), f"s{k % 50}" if k % 3 else "hot") for k in range(3000)]
    docs, mix = spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mix(block_rows=4, shards=8)
    want = sorted((r["doc"]["doc_id"], len(r["draws"])) for r in mixing.drawn(docs, ["doc_id"], mix=mix).collect())
    monkeypatch.setattr(mixing, "SOURCES", 7)
    monkeypatch.setattr(mixing, "STRETCHES", 4)
    out = mixing.drawn(docs, ["doc_id", "source"], mix=mix).collect()
    assert sorted((r["doc"]["doc_id"], len(r["draws"])) for r in out) == want  # groups decide shards alone
    by_shard = Counter(d["shard"] for r in out for d in r["draws"])
    assert set(by_shard) == set(range(8)) and max(by_shard.values()) < 1.3 * min(by_shard.values())
    assert all(len({d["epoch"] for d in r["draws"]}) == len(r["draws"]) for r in out)


def test_mix_quotas_with_given_totals():
    rng = random.Random(2)
    draws = [rng.randrange(60) for _ in range(90)]
    totals = mixing.split_quotas([sum(draws), 500], 16, 1)[0].tolist()
    q = mixing.split_quotas(draws, 16, 4, totals)
    assert q.sum(axis=1).tolist() == draws and q.sum(axis=0).tolist() == totals and (q >= 0).all()


def test_mix_written_by_shard(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixing.write_mix(docs, str(tmp_path / "mix"), mix=mixing.Mix(shards=4, block_rows=8))
    back = spark.read.parquet(str(tmp_path / "mix"))
    by = Counter(r["shard"] for r in back.select("shard").collect())
    assert set(by) == {0, 1, 2, 3} and max(by.values()) < 2 * min(by.values())
    assert back.drop("shard").columns == docs.columns


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("reference", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_random(reference):
    codec, rng = bpe.codec(RANKS, PATTERN), random.Random(2)
    texts = ["".join(rng.choice("abcdefthe inglo AZé漢😀\n\t 019.,'s") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a" * 5000, "the" * 3000, " " * 999, "ab" * 4000, "é" * 1000, "ing" * 700 + "s" * 700]
    for t in texts:
        ids = [i for piece in codec.encode(t) for i in piece]
        assert ids == reference.encode_ordinary(t)
        assert b"".join(map(bpe.vocabulary(RANKS).__getitem__, ids)) == t.encode()


@pytest.mark.parametrize("unit", ["-", " ", "a", "=-"])
def test_bpe_long_pieces(reference, unit):
    """A megabyte of one piece: memory in the length of the piece."""
    import tracemalloc

    codec, text = bpe.codec(RANKS, PATTERN), unit * (1_000_000 // len(unit))
    piece = text.encode()
    tracemalloc.start()
    ids = codec.piece_ids(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert list(ids) == reference._encode_single_piece(piece) and b"".join(map(bpe.vocabulary(RANKS).__getitem__, ids)) == piece


def test_bpe_other_vocabulary():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks, rng = bpe.read_ranks(path), random.Random(6)
    codec, want = bpe.Codec(ranks, PATTERN), tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(1500):
        t = "".join(rng.choice("aeiourstñéüß漢字かなпривет ") for _ in range(rng.randrange(50)))
        assert [i for piece in codec.encode(t) for i in piece] == want.encode_ordinary(t)


def test_bpe_edges(docs, none, reference, monkeypatch):
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN, ["doc_id", "text"]), RANKS).collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert r["ids"] == reference.encode_ordinary(r["doc"]["text"] or "") and bytes(r["decoded"]) == (r["doc"]["text"] or "").encode()
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN, ["doc_id"]), RANKS).count() == 0


def test_bpe_small_tables(reference, monkeypatch):
    """Tables that run full change nothing."""
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    codec = bpe.Codec(bpe.read_ranks(RANKS), PATTERN)
    assert [i for p in codec.encode(PROSE) for i in p] == reference.encode_ordinary(PROSE)


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randrange(80))]
        rows = packing.best_fit_decreasing(sizes, 50)
        assert sorted(k for r in rows for k in r) == list(range(len(sizes)))
        room: list[int] = []
        for n in sorted(sizes, reverse=True):
            fit = [x for x in room if x >= n]
            if fit:
                room.remove(min(fit))
            room.append((min(fit) if fit else 50) - n)
        assert sorted(50 - sum(sizes[k] for k in r) for r in rows) == sorted(room)


def test_packing_round_trip(docs, none, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_TOKENS", 4000)
    packed = packing.pack(docs, RANKS, PATTERN, end_id=50256, length=128)
    for r in packed.collect():
        positions = np.frombuffer(r["positions"], "<i4")
        assert len(r["ids"]) == 128 * r["id_bytes"] and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 128
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert (positions[a:b] == np.arange(b - a)).all() and b > a
    back = defaultdict(list)
    for r in packing.unpack(packed, RANKS, PATTERN).collect():
        back[r["doc_id"]].append((r["offset"], bytes(r["piece"])))
    single = {i: t for i, t in PAIRS if Counter(x for x, _ in PAIRS)[i] == 1}
    for i, t in single.items():
        assert b"".join(p for _, p in sorted(back[i])) == (t or "").encode()
    assert packing.pack(none, RANKS, PATTERN, 50256).count() == 0


def test_queries_match_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, sf)
        rel = con.sql(sql)
        assert sorted(got.columns) == sorted(rel.columns)
        cols = sorted(rel.columns)
        assert Counter(tuple(r[c] for c in cols) for r in got.collect()) == Counter(tuple(dict(zip(rel.columns, x))[c] for c in cols) for x in rel.fetchall()), name


def test_queries_by_brute_force(spark, sf, reference):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    by = lambda name: {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf).collect()}
    got = by("op1_simhash")
    for i, fp, least in brute.component_ids(rows):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{fp:016x}", least)
    got = by("op3_pii")
    for i, t in rows:
        spans = brute.base_spans(t)
        assert got[i]["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(got[i]["spans"].split(","))
    got = by("op9_byte_bpe")
    for i, t in rows:
        ids = reference.encode_ordinary(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    got = by("op10_quality_rules")
    for i, t in rows:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute.quality_counts(t)
