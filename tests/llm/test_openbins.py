"""Online best fit against a plain version; ids against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millwright.llm import openbins, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_as_the_library(library, monkeypatch):
    own, rng = openbins.vocabulary(PATH), random.Random(3)
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> c", " " * 2047 + "x", " " * 2048 + "x", " " * 2049, "a" + " " * 5000 + "b\n" + " \n" * 3000 + "\tx",
             "ab\n" * 2000 + " " * 2100 + "\x1c" * 3000 + " " * 2100, "-" * 20000, "a" * 20000, "漢字" * 5000, "the 12 mats\nI'll go's " * 300]
    alphabet = [" ", "\n", "　", "a", "1", "'s", "é", "\x1c", "\x85", "<|endoftext|>", "漢", "the", "\t"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(1500)]
    for stretch in (openbins.STRETCH, 20):
        monkeypatch.setattr(openbins, "STRETCH", stretch)
        for t in texts:
            assert own.ids(t, 2).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        openbins.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_borders():
    assert openbins.borders(3, 8) == [0, 3] and openbins.borders(8, 8) == [0, 8]
    assert openbins.borders(17, 8) == [0, 1, 9, 17] and openbins.borders(24, 8) == [0, 8, 16, 24]


@pytest.mark.parametrize("most", [1, 2, 7, 1000])
def test_open_bins_by_hand(most):
    rng = random.Random(most)
    for _ in range(60):
        own, bins, n_made = openbins.OpenBins(50, most), {}, 0
        for n in (rng.randint(1, 50) for _ in range(150)):
            fit = [b for b, room in bins.items() if room >= n]
            got, at = own.put(n)
            if fit:
                assert got in fit and bins[got] == min(bins[b] for b in fit) and at == 50 - bins[got]
                bins[got] -= n
            else:
                assert (got, at) == (n_made, 0)
                n_made += 1
                closed = None
                if n < 50 and len(bins) == most:
                    tight = min(bins.values())
                    closed = next(b for b in bins if bins[b] == tight and b not in own.bins[tight])
                if closed is not None:
                    del bins[closed]
                bins[got] = 50 - n
            bins = {b: room for b, room in bins.items() if room}
            assert own.n_open == len(bins) <= most and sorted(b for x in own.bins for b in x) == sorted(bins)


def checked(rows, placed, library, length):
    """Pieces cover the documents, sequences are gapless and not too long; the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in placed:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    want = []
    for i, each in texts.items():
        for ids in each:
            first = len(ids) % length or length
            cuts = [0, *range(first, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
            want += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(want) == sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed)
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by_sequence)


def test_query_by_brute_force(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    placed = queries.QUERIES["op13_best_fit"](spark, sf).collect()
    n = checked(rows, placed, library, 1024)
    assert n <= 1.02 * -(-sum(r["length"] for r in placed) // 1024) + 1


def test_edges_and_sequences(spark, library, monkeypatch):
    rng = random.Random(8)
    rows = [(None, None), (None, "a"), (1, ""), (2, "w " * 3000), (3, "x<|endoftext|>y"), *[(9, "same row of words")] * 40]
    rows += [(20 + k, "some words é 漢 " * rng.randrange(30)) for k in range(120)]
    docs = spark.createDataFrame([(i, t, "r", "s", "o") for i, t in rows], "doc_id long, text string, row string, ids string, offset string").repartition(3)
    monkeypatch.setattr(openbins, "PIECES", 32)
    cut = openbins.pieces(docs, PATH, 2, length=64)
    for open_bins in (1, 5, openbins.OPEN_BINS):
        placed = openbins.place(cut, 64, open_bins, per_packer=50)
        checked(rows, placed.collect(), library, 64)
    runs = {tuple(r["doc_ids"]): r for r in openbins.sequences(cut, placed).collect()}
    where = defaultdict(list)
    for r in placed.collect():
        where[r["sequence_id"]].append((r["offset"], r["doc_id"], r["length"], r["ids_crc32"]))
    assert len(where) == len(openbins.sequences(cut, placed).collect()) and runs
    for r in openbins.sequences(cut, placed).collect():
        ids = np.frombuffer(r["ids"], "<u2").astype("<u4")
        parts = sorted(where[r["sequence_id"]], key=lambda p: p[0])
        assert len(ids) == r["n_tokens"] and r["cu_seqlens"] == [0, *np.cumsum([p[2] for p in parts]).tolist()] and r["doc_ids"] == [p[1] for p in parts]
        assert [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:])] == [p[3] for p in parts]
    again = openbins.pack(docs, PATH, 2, length=64)
    assert sorted(map(str, again.collect())) == sorted(map(str, openbins.pack(docs, PATH, 2, length=64).collect()))
    assert openbins.pack(docs.limit(0), PATH, 2).count() == 0
