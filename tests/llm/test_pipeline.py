"""The corpus pipeline stage by stage against plain versions, and the guard of the entry module."""

from collections import Counter

import brute
import public_tokenizers
import tiktoken

import __spark_entry__
import corpus_pipeline
from millwright.llm import bpe, quality


def test_stages_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        results.append((name, docs.collect(), docs.columns))
    assert [n for n, _, _ in results] == ["quality rules", "line dedup", "simhash near-dedup", "mixing", "byte bpe"]
    assert all(c == columns for _, _, c in results[:-1])

    kept = {r["doc_id"]: r for r in results[0][1]}
    verdicts = {r["doc"]["doc_id"]: r["quality"]["kept"] for r in quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), ["doc_id"]).collect()}
    assert kept == {i: r for i, r in rows.items() if verdicts[i]}
    for i, r in rows.items():
        n, _, _, _, repeat = brute.quality_counts(r["text"])
        assert i not in kept or (n >= 20 and 100 * repeat <= 30 * n)

    cleaned = {i: t for i, _, _, t in brute.lines([(i, r["text"]) for i, r in kept.items()])}
    assert {r["doc_id"]: r["text"] for r in results[1][1]} == cleaned
    assert all(r["n_chars"] == len(r["text"]) for r in results[1][1] if r["text"] != kept[r["doc_id"]]["text"])

    first = {i for i, _, least in brute.component_ids(list(cleaned.items())) if i == least}
    assert Counter(r["doc_id"] for r in results[2][1]) == Counter(first)

    drawn = Counter(r["doc_id"] for r in results[3][1])
    assert set(drawn) <= first and max(drawn.values()) <= 2
    size = lambda i: len(brute.words(cleaned[i]))
    total = sum(map(size, first))
    assert abs(sum(n * size(i) for i, n in drawn.items()) - 1.5 * total) < 0.02 * total
    assert all(r["text"] == cleaned[r["doc_id"]] for r in results[3][1])

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r["doc_id"] for r in results[4][1]) == drawn
    for r in results[4][1]:
        assert r["round_trip"] and r["ids"] == plain.encode_ordinary(cleaned[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])


def test_stages_on_edge_tables(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, draws string, _lines string, lines string, gone string, doc string, _n_id string, quality string"
    rows = [(None, None, None, None, None, "x", "y", "l", "g", "d", "n", "q"), (1, "", "en", "a", 0, "x", "y", "l", "g", "d", "n", "q"), (2, "w " * 25000, "en", "a", 50000, "x", "y", "l", "g", "d", "n", "q"),
            *[(k, "the of and a river walks under the green stones of seven towns and " * 1 + " ".join(f"w{j}" for j in range(k, k + 60)), "en", None, 300, "x", "y", "l", "g", "d", "n", "q") for k in (3, 3, 4)]]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert all(r["round_trip"] for r in out.collect())


def test_entry_has_all_queries():
    names = __spark_entry__.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
