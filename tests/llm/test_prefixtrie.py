"""The prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest

from millwright.llm import prefixtrie as pt


def nodes_of(convs):
    """Rows as the contract has them, of {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        own = (len(m) - 1) * (len(brute.words(k[-1][1])) if k else 0)
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += not children[k]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items()
    )




COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def found(df, run_bytes):
    return Counter(tuple(r[c] for c in COLUMNS) for r in pt.prefix_trie(df, run_bytes).collect())


@pytest.mark.parametrize("run_bytes", [1, 300, pt.RUN_BYTES])
def test_random_conversations(spark, run_bytes):
    """Few different turns, so that most prefixes are shared, a third of all conversations alike, some without turns."""
    rng = random.Random(3)
    convs = {c: [("u", f"w {'x ' * k}") for k in (rng.randrange(3) for _ in range(rng.randrange(7)))] for c in range(240)}
    convs |= {c: [("u", "w "), ("a", "hot hot"), ("", "")] for c in range(1000, 1120)}
    convs |= {5000: [("u", f"long {k % 3}") for k in range(400)], 5001: [("u", f"long {k % 3}") for k in range(399)]}
    turns = [(c, [(hashlib.sha256(repr(t).encode()).digest()[:16], len(brute.words(t[1]))) for t in v]) for c, v in convs.items()]
    df = spark.createDataFrame(turns, "conv_id long, turns array<struct<id:binary,words:int>>").repartition(6)
    assert found(df, run_bytes) == nodes_of(convs)


def test_tables_with_nulls_and_clashing_names(spark):
    rows = [(20, 1, "u", "Hi there"), (20, 2, "a", "Hello"), (20, None, None, "system words"), (20, 3, "u", None), (21, 1, "u", "x"), (22, 1, "u", "x"), (22, 2, None, None),
            (23, 5, "u", "a b c"), (24, 1, "u", "Hi there"), (45, 1, "ua", "b"), (46, 1, "u", "ab"), (47, 1, "u", "ab"), (None, 1, "u", "lost"), (None, None, None, None),
            (-3, 1, "u", "minus"), (-20, 1, "a", "neg head"), (25, 1, "u", ""), (26, 1, "u", "w " * 30000), (27, 1, "u", "x\x0by\x0cz\xa0q"), (61, 1, "u", "z")]
    rows += [(c, t, "u", f"turn {t}") for c in (60, 62, 63, 64, 65, 66) for t in range(6)]
    extra = [(*r, "d", "k", "l", "n") for r in rows]
    df = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, digest string, key string, lo string, words string").repartition(4)
    want = nodes_of(rebuilt(rows))
    assert found(pt.with_shared_heads(pt.sequences(df)), 200) == want
    assert pt.prefix_trie(pt.with_shared_heads(pt.sequences(df.limit(0)))).count() == 0


def rebuilt(rows):
    """Rows (conv_id, turn, role, text) to conversations with shared heads; c % 20 has the sign of c, as in SQL."""
    heads = {c: c - (c % 20 if c >= 0 else -(-c % 20)) for c, *_ in rows if c is not None}
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    draw = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: own.get(heads[c], [])[: draw(c)] + v[draw(c) :] for c, v in own.items()}


def test_repeated_rows_are_turns(spark):
    df = spark.createDataFrame([(1, 1, "u", "x"), (1, 1, "u", "x"), (1, 2, "u", "y")], "conv_id long, turn long, role string, text string")
    assert pt.sequences(df).selectExpr("size(turns) n").collect()[0]["n"] == 3


def test_tree_layouts():
    """Nodes grow through all layouts; keys that are prefixes of others; every key is found again in order."""
    rng = random.Random(1)
    for width, count in ((2, 4), (2, 3000), (5, 2000), (1, 256)):
        keys = {bytes(rng.randrange(256) for _ in range(width * rng.randrange(4))) for _ in range(count)} | {b"", b"\0", b"\0\0"}
        tree, order = pt.Tree(), list(keys)
        for k in order:
            tree.insert(k, k)
        assert all(tree.get(k) == k for k in keys) and tree.get(b"\xff" * 50) is None

        def seen(node, above):
            here = above + node.path
            out = [node.value] if node.value is not None else []
            assert node.value in (None, here)
            for byte, below in node.children.pairs() if node.children is not None else ():
                out += seen(below, here + bytes([byte]))
            return out

        assert seen(tree.root, b"") == sorted(keys)
        if (width, count) == (2, 3000):
            assert isinstance(tree.root.children, pt.Direct)
    sizes = {}
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        tree = pt.Tree()
        for b in range(n):
            tree.insert(bytes([b]), b)
        sizes[n] = (type(tree.root.children), tree.root.children.room) if n > 1 else None
    assert sizes == {1: None, 4: (pt.Small, 4), 5: (pt.Small, 16), 16: (pt.Small, 16), 17: (pt.Indexed, 48), 48: (pt.Indexed, 48), 49: (pt.Direct, 256), 256: (pt.Direct, 256)}


def test_only_whole_turns_are_nodes():
    """Ids that share some bytes branch inside a turn; no node there."""
    ids = [bytes([7] * k + [k] * (16 - k)) for k in range(16)]
    keys = sorted({a + b for a in ids for b in ids})
    out = pt.walked(keys, [(1, k) for k in range(len(keys))], [[1, 1]] * len(keys), -1, -1)
    assert Counter(out["depth"]) == Counter({0: 1, 1: len(set(ids)), 2: len(keys)})
