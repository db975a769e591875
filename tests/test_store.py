"""The keyed store: upserts, versions, writers in sequence, broken writes, compaction."""

import pytest
from pyspark.errors import AnalysisException

from millwright.operators.store import KeyedStore

SCHEMA = "plant string, kind string, mapping string, at long"


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, str(tmp_path / "store"), SCHEMA, ["plant", "kind"], "at")


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _read(store, number=None):
    return sorted(map(tuple, store.read(number).collect()), key=str)


def test_upserts_and_versions(spark, store):
    assert store.version() == 0 and _read(store) == []
    assert store.upsert(_df(spark, [("a", "x", "one", 1), ("a", "x", "two", 2), ("b", "x", "b1", 5), (None, "x", "n", 1)])) == 1
    assert _read(store) == sorted([("a", "x", "two", 2), ("b", "x", "b1", 5), (None, "x", "n", 1)], key=str)
    store.upsert(_df(spark, [("a", "x", "three", 3), ("b", "x", "late", 4)]))  # the second is older than what is there
    assert _read(store) == sorted([("a", "x", "three", 3), ("b", "x", "b1", 5), (None, "x", "n", 1)], key=str)
    assert _read(store, 1) == sorted([("a", "x", "two", 2), ("b", "x", "b1", 5), (None, "x", "n", 1)], key=str)
    listed = [(r["at"], r["mapping"], r["is_latest"]) for r in store.listing().collect()]
    assert listed[0] == (5, "b1", True) and (2, "two", False) in listed and [x[0] for x in listed] == sorted([x[0] for x in listed], reverse=True)


def test_two_writers_and_a_broken_write(spark, store):
    store.upsert(_df(spark, [("a", "x", "one", 1)]))
    seen = store.version()
    assert store.upsert(_df(spark, [("a", "x", "two", 2)]), seen) == 2
    with pytest.raises(AnalysisException):
        store.upsert(_df(spark, [("a", "x", "other", 3)]), seen)  # the second writer began from an old version
    assert _read(store) == [("a", "x", "two", 2)]  # its folder is there, but no version names it
    store._written(_df(spark, [("a", "x", "broken", 9)]))
    assert _read(store) == [("a", "x", "two", 2)]
    assert store.upsert(_df(spark, [("a", "x", "other", 3)])) == 3 and _read(store) == [("a", "x", "other", 3)]


def test_compaction_keeps_readers_whole(spark, store):
    for k in range(4):
        store.upsert(_df(spark, [("a", "x", f"m{k}", k), (f"p{k}", "x", "own", k)]))
    before, old = _read(store), store.version()
    reader = store.read()
    assert store.compact() == old + 1 and len(store.folders(old + 1)) == 1
    assert _read(store) == before == _read(store, old) and sorted(map(tuple, reader.collect()), key=str) == before
    assert KeyedStore(spark, store.path, SCHEMA, ["plant", "kind"], "at").compact() == old + 2
