"""Conversation prefix trie by Patricia construction.

Conversations are rows of names, a name being a digest of a turn's role and text.  Distinct rows
are sorted by range over all tasks.  Each part of the order builds its own trie from neighbours:
only branch points, ends and leaves become points, with compressed edges between them; counts
are added up on the points; then the unary nodes of an edge come from the point below and the
suffix sums of the edge's words.  Prefixes that a part shares with its neighbours are points in
each of them; all that is counted there is a sum or a least value, so the copies are merged by
one aggregate.  A node that runs on from an earlier part counts as a child, and counts its
words, only where it begins.

The saved tokens of a node need no second walk: a subtree's sum of (members - 1) x words is its
members' words from the node on, less the words of each distinct node once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from landshift.llm.common import arrow, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a turn's name; distinct rows of a part; conversation numbers of a piece of a list.
NAME, PART, PIECE = 32, 100_000, 8192
EMPTY = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``, an array of (name, words) by turn, null first; turns of one number by role and name."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, NAME)
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    ordered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return ordered.withColumn("turns", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))))


def rebuilt(convs: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family, then its own after its first h; h = crc32(c) % heads."""
    head = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = convs.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, max(heads - 1, 1)).alias("_first"))
    both = convs.withColumns({"_head": head, "_h": h}).join(first, "_head", "left")
    none = F.slice("turns", 1, 0)
    start = F.when(F.col("_h") > 0, F.slice(F.coalesce("_first", none), 1, F.col("_h"))).otherwise(none)
    own = F.when(F.size("turns") > F.col("_h"), F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(1)))).otherwise(none)
    return both.select("conv_id", F.concat(start, own).alias("turns"))


def ends(keyed: DataFrame) -> DataFrame:
    """``key_name`` and ``ends_sha256`` of the conversations of each key, numbers ascending, joined by commas.

    A hot key's list is cut to pieces where it is sorted, by range over many tasks; the pieces
    then run through one hasher, as a SHA-256 must, a piece in memory at a time.
    """
    schema = "key_name string, first long, piece string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_of(schema)
        name, ids, out = None, [], []
        for batch in batches:
            for k, c in zip(batch.column("key_name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if (k != name or len(ids) >= PIECE) and ids:
                    out.append((name, ids[0], ",".join(map(str, ids))))
                    ids = []
                name = k
                ids.append(c)
            if len(out) >= 1024:
                yield rows(out, to)
                out = []
        if ids:
            out.append((name, ids[0], ",".join(map(str, ids))))
        yield rows(out, to)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_of("key_name string, ends_sha256 string")
        name, state = None, None
        for batch in batches:
            out = []
            for k, p in zip(batch.column("key_name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if k == name:
                    state.update(b"," + p.encode())
                else:
                    if state:
                        out.append((name, state.hexdigest()))
                    name, state = k, hashlib.sha256(p.encode())
            yield rows(out, to)
        if state:
            yield rows([(name, state.hexdigest())], to)

    cut = keyed.select("key_name", "conv_id").repartitionByRange("key_name", "conv_id").sortWithinPartitions("key_name", "conv_id").mapInArrow(pieces, schema)
    return cut.repartition("key_name").sortWithinPartitions("key_name", "first").select("key_name", "piece").mapInArrow(hashed, "key_name string, ends_sha256 string")


def arrow_of(schema: str) -> pa.Schema:
    """An Arrow schema of long and string columns, without a session."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def rows(found: list[tuple], to: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[] for _ in to]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, to, strict=True)], schema=to)


@F.pandas_udf(LongType())
def shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Names that two keys begin with alike; -1 if one is missing."""

    def one(x: str | None, y: str | None) -> int:
        if x is None or y is None:
            return -1
        n = min(len(x), len(y))
        p, q = (np.frombuffer(v[:n].encode(), np.uint8) for v in (x, y))
        apart = np.flatnonzero(p != q)
        return (int(apart[0]) if len(apart) else n) // NAME

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


NODE = "part int, serial long, above long, prefix string, owner boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, member_words long, node_words long, words_before long, ends_sha256 string"


class Node:
    """A node and the sums of its members and of its subtree."""

    __slots__ = ("serial", "above", "prefix", "owner", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "member_words", "node_words", "words_before", "ends_sha256")

    def __init__(self, serial: int, depth: int):
        self.serial, self.depth, self.owner, self.ends_sha256 = serial, depth, True, EMPTY
        self.above = self.prefix = self.conv_id = self.parent_conv_id = None
        self.n_convs = self.n_children = self.n_leaves = self.member_words = self.node_words = self.words_before = 0

    def join(self, conv_id: int, n_convs: int, member_words: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs
        self.member_words += member_words


class Part:
    """The trie of one part of the order, built from its sorted distinct keys."""

    def __init__(self, before: int, after: int):
        #: depths that the first key shares with the part before, the last with the part after (-1: no such part)
        self.before, self.after = before, after
        self.nodes: list[Node] = []

    def node(self, depth: int) -> Node:
        self.nodes.append(Node(len(self.nodes), depth))
        return self.nodes[-1]

    @staticmethod
    def hang(child: Node, above: Node) -> None:
        """Adds a finished node's sums to those of the node above; one that runs on from an earlier part is a child there."""
        above.join(child.conv_id, child.n_convs, child.member_words)
        above.n_children += child.owner
        above.n_leaves += child.n_leaves
        above.node_words += child.node_words
        child.above = above.serial

    def settle(self, point: Node, above: Node, upto: np.ndarray) -> None:
        """Finishes a point, expands its edge from below, and hangs the edge's top under the point above."""
        d = point.depth
        point.words_before = int(upto[d - 1])
        if point.owner:
            point.node_words += int(upto[d] - upto[d - 1])
        for e in range(d - 1, above.depth, -1):
            unary = self.node(e)
            self.hang(point, unary)
            unary.node_words += int(upto[e] - upto[e - 1])
            unary.words_before = int(upto[e - 1])
            point = unary
        self.hang(point, above)

    def build(self, keys: list[str], counts: list[int], least: list[int], words: list[np.ndarray], digests: list[str]) -> list[Node]:
        last, path = len(keys) - 1, [self.node(0)]
        path[0].owner = self.before < 0
        reach = [common(a, b) for a, b in zip(keys, keys[1:], strict=False)] + [self.after]
        upto = None
        for k, key in enumerate(keys):
            depth, same = len(key) // NAME, reach[k - 1] if k else 0
            while path[-1].depth > same:
                point = path.pop()
                if path[-1].depth < same:
                    path.append(self.node(same))  # a branch
                self.settle(point, path[-1], upto)
            upto = np.concatenate([[0], np.cumsum(words[k], dtype=np.int64)])
            if depth > path[-1].depth:
                path.append(self.node(depth))  # an end
            if not k:
                self.share(path, key, self.before)
                for p in path:
                    p.owner = p.depth > self.before
            if k == last:
                self.share(path, key, self.after)
            end = next(p for p in reversed(path) if p.depth == depth)
            end.join(least[k], counts[k], counts[k] * int(upto[-1]))
            end.ends_sha256 = digests[k]
            end.n_leaves += reach[k] < depth  # nothing goes on from it
        while len(path) > 1:
            self.settle(path.pop(), path[-1], upto)
        for x in self.nodes:
            if x.above is not None and self.nodes[x.above].prefix is None:
                x.parent_conv_id = self.nodes[x.above].conv_id
        return self.nodes

    def share(self, path: list[Node], key: str, reach: int) -> None:
        """Makes every depth that the path shares with a neighbouring part a point with a name; none of them has lost a child yet."""
        have = {p.depth for p in path}
        path += [self.node(d) for d in range(reach + 1) if d not in have]
        path.sort(key=lambda p: p.depth)
        digest = hashlib.sha256()
        for p in path[: reach + 1]:
            if p.depth:
                digest.update(key[(p.depth - 1) * NAME : p.depth * NAME].encode())
            p.prefix = digest.hexdigest()


def common(a: str, b: str) -> int:
    """Names that two keys begin with alike."""
    n, d = min(len(a), len(b)), 0
    while d < n and a[d : d + NAME] == b[d : d + NAME]:
        d += NAME
    return d // NAME


def trie(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every node of the rebuilt conversations' trie, named by ``conv_id`` (its smallest member) and ``depth``.

    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 are as the README states.

    Defined cases: rows without conv_id belong to no conversation; a null role or text is empty;
    turns are taken null first, those of one number by role, then by the text's digest, and
    repeated rows are turns of their own; a conversation without any turn left is a member of
    the root alone; texts of any length count as their digest and their words; an empty table
    has no node, not even the root; other columns are not looked at.  One conversation's digests
    (some 100 bytes a turn) must fit a task's memory, its texts need not.
    """
    keyed = rebuilt(conversations(turns), family, heads)
    key = F.array_join(F.transform("turns", lambda t: t["name"]), "")
    keyed = stored(keyed.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"), F.sha2(key, 256).alias("key_name")))
    distinct = keyed.groupBy("key", "key_name").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("words").alias("words"))
    distinct = stored(distinct.join(ends(keyed), "key_name").drop("key_name"))
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // PART))
    ordered = stored(distinct.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    by_part = Window.orderBy("part")  # a row a part
    edges = ordered.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    edges = edges.select("part", shared(F.lag("hi").over(by_part), F.col("lo")).alias("before"), shared("hi", F.lead("lo").over(by_part)).alias("after"))
    to = arrow(NODE)

    def one(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("key", "ascending")]))
        part = Part(t["before"][0].as_py(), t["after"][0].as_py())
        words = [np.array(w, np.int64) for w in t["words"].to_pylist()]
        found = part.build(*(t[c].to_pylist() for c in ("key", "n", "conv_id")), words, t["ends_sha256"].to_pylist())
        cols = {c: [getattr(x, c) for x in found] for c in Node.__slots__} | {"part": [t["part"][0].as_py()] * len(found)}
        return pa.Table.from_arrays([pa.array(cols[f.name], f.type) for f in to], schema=to)

    nodes = stored(ordered.join(edges, "part").groupBy("part").applyInArrow(one, NODE))
    sums = ("n_convs", "n_children", "n_leaves", "member_words", "node_words")
    copies = nodes.where("prefix IS NOT NULL")
    digest = F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256")))
    merged = copies.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums), F.coalesce(digest, F.lit(EMPTY)).alias("ends_sha256"))
    whole = stored(copies.select("part", "serial", "above", "prefix", "owner", "depth", "parent_conv_id", "words_before").join(merged, "prefix"))
    each = nodes.where("prefix IS NULL").unionByName(whole.where("owner"))
    # A node under a shared one learns its parent's name from its own part's copy.
    parents = whole.select("part", F.col("serial").alias("above"), F.col("conv_id").alias("_named"))
    out = each.join(parents, ["part", "above"], "left")
    saved = F.col("member_words") - F.col("n_convs") * F.col("words_before") - F.col("node_words")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "_named").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), "ends_sha256")
