"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids.

*Keys.*  A turn's id is ``WIDTH`` bytes, big-endian: the first half of the SHA-256 of role and text (two different turns
of 10**12 share one with a probability under 10**-14).  A conversation's key is the ids of its turns in order, so
prefixes of keys at whole multiples of ``WIDTH`` are prefixes of conversations.

*Trees.*  Distinct keys, each with its number of members and smallest member, are sorted by range over all
tasks and cut into runs of bounded size.  Every run is one adaptive radix tree: inner nodes with 4, 16, 48
or 256 places that grow as children come, and path compression (bytes without a branch are kept in one
node).  A walk of the tree closes nodes from below and emits only those at whole turns, also the ones inside a
compressed path.

*Nodes that several runs share* lie on the first or last key of a run.  A run knows how many turns its first key
shares with the last key before it and its last key with the first one behind, so that it counts a node as a new
child, and as distinct text, only where the node first occurs.  All figures of a node are then plain sums (members: least id)
over runs, and only shared nodes are shuffled.

*Member lists* (digests of ids that end at a node) go as strings of at most ``2**ID_BITS`` ids each, streamed
in order through the hash by one task of bounded memory.

Scale: what crosses the network are keys (``WIDTH`` bytes a turn), not texts.  Copies of a conversation are added
up before the sort, so a key is one row however many have it; a hot first turn is cut wherever a run is full.  The driver
gets two small numbers for each sort partition.  One conversation's key is held whole, as one text is elsewhere.

Defined results: turns are ordered by number (null first), then id; a null role or text is empty; rows without
conv_id belong to no conversation and are left out; repeated rows are turns of their own; a missing head conversation gives no turns;
no rows give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.llm.common import arrow_pass, prepare, stored, text_or_empty, word_count

WIDTH = 16
#: Bytes of keys in a run.
RUN_BYTES = 1 << 22
#: Ids of a string have all but so many low bits in common.
ID_BITS = 12
CONV_BASE = 20


# --- adaptive radix tree

class Small:
    """Up to ``room`` children: their bytes in order, and beside them the nodes."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int, pairs=()):
        self.room = room
        self.bytes, self.nodes = bytearray(b for b, _ in pairs), [n for _, n in pairs]

    def get(self, byte: int):
        k = self.bytes.find(byte)
        return self.nodes[k] if k >= 0 else None

    def put(self, byte: int, node) -> bool:
        """False if there is no room for another child."""
        k = self.bytes.find(byte)
        if k >= 0:
            self.nodes[k] = node
            return True
        if len(self.nodes) == self.room:
            return False
        k = sum(b < byte for b in self.bytes)
        self.bytes.insert(k, byte), self.nodes.insert(k, node)
        return True

    def pairs(self):
        return list(zip(self.bytes, self.nodes))


class Indexed:
    """Up to 48 children: a place by byte, nodes as they came."""

    __slots__ = ("place", "nodes")
    room = 48

    def __init__(self, pairs=()):
        self.place, self.nodes = bytearray(256), []
        for byte, node in pairs:
            self.put(byte, node)

    def get(self, byte: int):
        k = self.place[byte]
        return self.nodes[k - 1] if k else None

    def put(self, byte: int, node) -> bool:
        k = self.place[byte]
        if k:
            self.nodes[k - 1] = node
            return True
        if len(self.nodes) == self.room:
            return False
        self.nodes.append(node)
        self.place[byte] = len(self.nodes)
        return True

    def pairs(self):
        return [(b, self.nodes[k - 1]) for b, k in enumerate(self.place) if k]


class Direct:
    """All 256 children by byte."""

    __slots__ = ("nodes",)
    room = 256

    def __init__(self, pairs=()):
        self.nodes = [None] * 256
        for byte, node in pairs:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def pairs(self):
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


def grown(children):
    """The next larger layout with the same children."""
    pairs = children.pairs()
    if children.room == 4:
        return Small(16, pairs)
    return Indexed(pairs) if children.room == 16 else Direct(pairs)


class Node:
    """``path``: the compressed bytes behind the byte that leads here; ``value``: what ends behind them."""

    __slots__ = ("path", "value", "children")

    def __init__(self, path: bytes, value=None, children=None):
        self.path, self.value, self.children = path, value, children

    def put(self, byte: int, node: "Node") -> None:
        if self.children is None:
            self.children = Small(4)
        while not self.children.put(byte, node):
            self.children = grown(self.children)


def common_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b[: len(a)]:
        return len(a)
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] is shared, a[:hi] is not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Tree:
    """Adaptive radix tree of byte strings; one may be a prefix of another."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            n = common_length(node.path, key[at : at + len(node.path)])
            if n < len(node.path):  # the path is split where the key leaves it
                rest = Node(node.path[n + 1 :], node.value, node.children)
                byte, node.path, node.value, node.children = node.path[n], node.path[:n], None, None
                node.put(byte, rest)
            at += n
            if at == len(key):
                node.value = value
                return
            below = node.children.get(key[at]) if node.children is not None else None
            if below is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            node, at = below, at + 1

    def get(self, key: bytes):
        node, at = self.root, 0
        while node is not None and key[at : at + len(node.path)] == node.path:
            at += len(node.path)
            if at == len(key):
                return node.value
            node, at = (node.children.get(key[at]) if node.children is not None else None), at + 1
        return None


# --- the nodes of a run

class Totals:
    """What is known of the subtree at the place of a walk."""

    __slots__ = ("n", "lo", "fresh", "below", "leaves", "saved", "tops")

    def __init__(self):
        self.n, self.lo, self.fresh, self.below, self.leaves, self.saved = 0, None, 0, False, 0, 0
        self.tops: list[int] = []  # nodes at the next whole turn below

    def add(self, other: "Totals") -> None:
        self.n += other.n
        self.lo = other.lo if self.lo is None else self.lo if other.lo is None else min(self.lo, other.lo)
        self.fresh += other.fresh
        self.below |= other.below
        self.leaves += other.leaves
        self.saved += other.saved
        self.tops += other.tops


def walked(keys: list[bytes], values: list[tuple[int, int]], words: list[list[int]], before: int, behind: int, width: int = WIDTH) -> dict[str, list]:
    """Rows of the turn-aligned nodes of sorted distinct ``keys``.

    ``values``: (members, smallest member) of a key, ``words``: words of its turns.  ``before`` and ``behind``: turns shared by the first
    key and the last one of the run before, the last key and the first one of the run behind; -1: there is none.
    """
    tree = Tree()
    for k, key in enumerate(keys):
        tree.insert(key, k)
    first, last = keys[0], keys[-1]
    out: dict[str, list] = {c: [] for c in ("digest", "parent_digest", "depth", "n", "lo", "children", "leaves", "saved", "shared", "parent_shared", "parent_lo")}

    def close(at: Totals, depth: int, count: int, digest: bytes, above: bytes | None, known: bool, goes_on: bool) -> None:
        """A node is complete: emit it and make ``at`` what its parent sees.  ``known``: the run before has it, ``goes_on``: the run behind."""
        at.leaves += not at.below and not goes_on
        at.saved += (at.n if known else at.n - 1) * count
        shared, row = known or goes_on, len(out["n"])
        values = (digest, above, depth, at.n, at.lo, at.fresh, at.leaves, at.saved, shared, None, None)
        for c, v in zip(out.values(), values):
            c.append(v)
        for child in at.tops:
            out["parent_shared"][child], out["parent_lo"][child] = shared, at.lo
        at.fresh, at.below, at.tops = int(not known), True, [row]

    def any_key(node: Node) -> int:
        while node.value is None:
            node = node.children.pairs()[0][1]
        return node.value

    # (node, bytes above its path, a key in its subtree, whether its children are done): down, then up with their totals
    digests = [hashlib.sha256(b"")]  # of each whole number of turns on the way to the place of the walk
    stack: list[tuple] = [(tree.root, 0, any_key(tree.root), None)]
    totals: list[Totals] = []
    while stack:
        node, start, k, done = stack.pop()
        end = start + len(node.path)
        key = keys[k]
        # whole turns that end inside this node's bytes: behind the byte that leads here, or anywhere in its path
        lowest = 0 if start == 0 else (start - 1) // width + 1
        if done is None:
            del digests[max(1, lowest) :]
            while len(digests) <= end // width:
                d = digests[-1].copy()
                d.update(key[(len(digests) - 1) * width : len(digests) * width])
                digests.append(d)
            totals.append(Totals())
            stack.append((node, start, k, True))
            if node.children is not None:
                stack += [(below, end + 1, any_key(below), None) for _, below in reversed(node.children.pairs())]
            continue
        own = totals.pop()
        del digests[end // width + 1 :]
        if node.value is not None:
            n, lo = values[node.value]
            ended = Totals()
            ended.n, ended.lo = n, lo
            own.add(ended)
        known, goes_on = min(before, common_length(key, first) // width), min(behind, common_length(key, last) // width)
        for depth in range(end // width, lowest - 1, -1):
            above = digests[depth - 1].digest()[:WIDTH] if depth else None
            close(own, depth, words[k][depth - 1] if depth else 0, digests[depth].digest()[:WIDTH], above, depth <= known, depth <= goes_on)
        if totals:
            totals[-1].add(own)
    return out


# --- Spark

def turn_id(role: Column, text: Column) -> Column:
    """``WIDTH`` bytes; the length of the role keeps (role, text) apart from (role + text, '')."""
    spelled = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(spelled, 256)), 1, WIDTH)


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as structs (id, words)."""
    role, text = text_or_empty(F.col(role_col)), text_or_empty(F.col(text_col))
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), turn_id(role, text).alias("id"), word_count(F.col(text_col)).cast("int").alias("words"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns"))


def with_shared_heads(convs: DataFrame, base: int = CONV_BASE, heads: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % base; h = crc32(decimal c) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    heads_of = convs.filter(F.col("conv_id") % base == 0).select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, heads - 1).alias("head"))
    mine = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % base).alias("base_id"))
    empty = F.array().cast(convs.schema["turns"].dataType)
    head = F.slice(F.coalesce("head", empty), F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.lit(0), F.size("turns") - F.col("h")))
    return mine.join(heads_of, "base_id", "left").select("conv_id", F.concat(head, own).alias("turns"))


def _keyed(convs: DataFrame) -> DataFrame:
    """(conv_id, key, words): the turn ids as one binary, the words of the turns as an array."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    return convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))


def _runs(run_bytes: int):
    """Sorted rows (key, words, n, lo) of a partition to one row per run."""
    kinds = {"key": pa.binary(), "words": pa.list_(pa.int32()), "n": pa.int64(), "lo": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size, before = TaskContext.get().partitionId(), 0, 0, None
        held: dict[str, list] = {c: [] for c in kinds}

        def row(behind: int | None) -> pa.RecordBatch:
            place = [pa.array([v], pa.int32()) for v in (part, number, before, behind)]
            ends = [pa.array([held["key"][k] if known is None else None], pa.binary()) for k, known in ((0, before), (-1, behind))]
            lists = [pa.array([v], pa.list_(kind)) for v, kind in zip(held.values(), kinds.values())]
            return pa.RecordBatch.from_arrays(place + ends + lists, ["part", "number", "before", "behind", "first", "last", "keys", "words", "n", "lo"])

        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if size >= run_bytes:  # full, and another key follows
                    shared = common_length(held["key"][-1], values[0]) // WIDTH
                    yield row(shared)
                    held, size, before, number = {c: [] for c in kinds}, 0, shared, number + 1
                for c, v in zip(held.values(), values):
                    c.append(v)
                size += len(values[0]) + 32
        if held["key"]:
            yield row(None)

    return run


RUN_SCHEMA = "part int, number int, before int, behind int, first binary, last binary, keys array<binary>, words array<array<int>>, n array<long>, lo array<long>"


def _bordered(runs: DataFrame) -> DataFrame:
    """``runs`` with ``before`` and ``behind`` also where a run is the first or last one of its sort partition.

    The window and the broadcast have a row for each sort partition; of the keys only two numbers of shared turns are broadcast.
    """
    ends = runs.filter(F.col("first").isNotNull() | F.col("last").isNotNull()).groupBy("part").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    order = Window.partitionBy().orderBy("part")
    shared = lambda a, b: F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(_shared_turns(a, b))
    around = ends.select("part", shared(F.lag("last").over(order), F.col("first")).alias("p"), shared(F.col("last"), F.lead("first").over(order)).alias("q"))
    filled = runs.join(F.broadcast(around), "part").withColumns({"before": F.coalesce("before", "p"), "behind": F.coalesce("behind", "q")})
    return filled.select("before", "behind", "keys", "words", "n", "lo")


def _shared_turns(a: Column, b: Column) -> Column:
    """Whole turns that two keys share."""
    turns = F.least(F.length(a), F.length(b)) / WIDTH
    part = lambda key, i: F.substring(key, i * WIDTH + 1, F.lit(WIDTH))
    places = F.when(turns >= 1, F.sequence(F.lit(0), (turns - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: part(a, i) != part(b, i))
    return F.coalesce(F.array_min(differ), turns.cast("int"))


NODE_SCHEMA = (
    "digest binary, parent_digest binary, depth int, n long, lo long, children long, leaves long, saved long, shared boolean, parent_shared boolean, parent_lo long"
)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs to nodes."""
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64())
    for batch in batches:
        for k in range(batch.num_rows):
            before, behind, keys, words, n, lo = (batch.column(c)[k].as_py() for c in range(6))
            rows = walked(keys, list(zip(n, lo)), words, before, behind)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(rows.values(), kinds)], list(rows))


def _member_digests(keyed: DataFrame, id_bits: int = ID_BITS) -> DataFrame:
    """(digest, ends_sha256) of every key that a conversation has, over its members' ids in order."""
    digest = F.substring(F.unhex(F.sha2("key", 256)), 1, WIDTH)
    spelled = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = keyed.select(digest.alias("digest"), "conv_id", F.shiftright("conv_id", id_bits).alias("place"))
    ranges = ranges.groupBy("digest", "place").agg(spelled.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            digests, hashes = [], []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d == current:
                    state.update(b",")
                else:
                    if current is not None:
                        digests.append(current), hashes.append(state.hexdigest())
                    current, state = d, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(hashes, pa.string())], ["digest", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["digest", "ends_sha256"])

    ordered = ranges.repartition("digest").sortWithinPartitions("digest", "place").select("digest", "ids")
    return arrow_pass(ordered, run, "digest binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Nodes of the trie of conversations (conv_id, turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and ``digest``, which names a node."""
    prepare(convs.sparkSession)
    keyed = stored(_keyed(convs), "trie-keys")
    distinct = stored(keyed.groupBy("key").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo")), "trie-distinct")
    runs = stored(arrow_pass(distinct.repartitionByRange("key").sortWithinPartitions("key"), _runs(run_bytes), RUN_SCHEMA), "trie-runs")
    nodes = stored(arrow_pass(_bordered(runs), _tries, NODE_SCHEMA), "trie-nodes")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    merged = nodes.filter("shared").groupBy("digest", "parent_digest", "depth").agg(*sums, F.min("lo").alias("lo"))
    merged = stored(merged, "trie-shared")
    columns = ["digest", "parent_digest", "depth", "n", "lo", "children", "leaves", "saved"]
    whole = nodes.filter(~F.col("shared"))
    inside = whole.filter(~F.coalesce(F.col("parent_shared"), F.lit(False))).select(*columns, "parent_lo")
    under = whole.filter("parent_shared").select(*columns).unionByName(merged.select(*columns))
    above = merged.select(F.col("digest").alias("parent_digest"), F.col("lo").alias("parent_lo"))
    under = under.join(above, "parent_digest", "left").select(*columns, "parent_lo")
    found = inside.unionByName(under).join(_member_digests(keyed), "digest", "left")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select(
        long("lo", "conv_id"), long("depth", "depth"), long("parent_lo", "parent_conv_id"), long("n", "n_convs"), long("children", "n_children"),
        long("leaves", "n_leaves"), long("saved", "saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "digest",
    )
