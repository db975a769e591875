"""Fill-in-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from millwright.llm import fim

TEXTS = [None, "", "a", "é漢😀x", "\n", "\n\n", "a\nb", "a\nb\n", "<P> in a text", "tail <M>", "<S", "<S><", "x" * 7, "x" * 8, "é" * 9, "word " * 9000, "漢字\n" * 700, "𝄞" * 33]


def plain(doc_id, text, sentinels=("<P>", "<S>", "<M>"), percent=90, spm=20, unit="chars", seed=1):
    """n, form, code points of prefix and middle, output."""
    t = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = list(t) if unit == "chars" else re.findall("[^\n]*\n|[^\n]+", t)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in sentinels) or h[2] % 100 >= percent:
        return n, "plain", None, None, t
    P, S, M = sentinels
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"{S}{s}{P}{p}{M}{m}"
    return n, "psm", len(p), len(m), f"{P}{p}{S}{s}{M}{m}"


@pytest.mark.parametrize("unit", fim.UNITS)
def test_borders_by_hand(unit):
    rng = random.Random(7)
    for _ in range(300):
        t = "".join(rng.choice("a\nbé漢😀") for _ in range(rng.randrange(60)))
        data = np.frombuffer(t.encode(), np.uint8)
        found = fim.Borders(data, unit)
        units = list(t) if unit == "chars" else t.split("\n")[:-1]
        ends = np.cumsum([len(x.encode()) + (unit == "lines") for x in units], dtype=np.int64)
        assert found.select(np.arange(1, len(ends) + 1)).tolist() == ends.tolist()
        places = np.arange(len(data) + 1)
        assert found.rank(places).tolist() == [int((ends <= p).sum()) for p in places]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_rows(spark, unit, monkeypatch):
    rng = random.Random(5)
    rows = [(k if k % 9 else None, TEXTS[k % len(TEXTS)] if k < 120 else "".join(rng.choice("ab \n<é漢😀") for _ in range(rng.randrange(90))), "x", "y", "z") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, form string, h1 string").repartition(3)
    for stretch in (fim.STRETCH_BYTES, 50):
        monkeypatch.setattr(fim, "STRETCH_BYTES", stretch)
        out = fim.fill_in_middle(docs, ["doc_id", "text", "doc"], unit=unit).withColumn("back", _back())
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            f = r["fim"]
            assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == plain(r["doc"]["doc_id"], r["doc"]["text"], unit=unit)
            assert r["back"] == (r["doc"]["text"] or "")
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0), ["doc_id"]).count() == 0


def _back(sentinels=fim.Sentinels()):
    from pyspark.sql import functions as F

    return fim.restore(F.col("fim.output"), F.col("fim.form"), sentinels)


def test_other_parameters(spark):
    docs = spark.createDataFrame([(k, f"text {k} of é words" * (k % 5)) for k in range(200)], "doc_id long, text string")
    marks = fim.Sentinels("[pre]", "[suf]", "[mid]")
    for r in fim.fill_in_middle(docs, ["doc_id", "text"], seed=9, percent=100, spm_percent=50, sentinels=marks).withColumn("back", _back(marks)).collect():
        f = r["fim"]
        assert (f["n"], f["form"], f["prefix_chars"], f["middle_chars"], f["output"]) == plain(r["doc"]["doc_id"], r["doc"]["text"], ("[pre]", "[suf]", "[mid]"), 100, 50, seed=9)
        assert r["back"] == r["doc"]["text"]


@pytest.mark.parametrize("marks", [("aa", "b", "c"), ("<P>", "<P>x", "q"), ("ab", "ba", "c"), ("", "b", "c"), ("x", "x", "y")])
def test_sentinels_that_could_be_misread(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)
