"""Prefix trie of conversations by splitters and their skeleton.

A conversation is a path: the digests of its turns, one after another.  Paths are cut into ranges by
splitters from a bounded sample, in the order of (path, conversation), so that copies of one
conversation part as well.  The skeleton, all prefixes of the splitters' paths, is broadcast.  A
node off the skeleton has all its members in one shard: the sorted shard opens and closes it, like
brackets, and finishes it there.  A node of the skeleton may have members in many shards: each adds
a partial aggregate, and the partials are reduced by node.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast, held, quoted, saved, tuned

WIDTH = 16  # bytes of a turn's digest
SAMPLED = 16  # paths looked at for each splitter
ENDS = 1 << 16  # characters of conversation numbers in one piece of a long list

PATHS = "conv_id long, path binary, sizes binary"
NODES = ("kind int, conv_id long, depth int, parent_conv_id long, parent_node int, n_convs long, n_children long, "
         "n_leaves long, saved_tokens decimal(38,0), ends_sha256 string, node int, size long, shard int, piece int, ends string")
NODE, PARTIAL, PIECE = 0, 1, 2  # kinds of row
NONE = hashlib.sha256(b"").hexdigest()


def paths_of(turns: DataFrame) -> DataFrame:
    """``conv_id, items``: the turns (sym, size) of every rebuilt conversation.

    ``turns`` has conv_id, turn, role, text.  Turns are ordered by turn (null first), equal ones by their digest.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    sym = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    item = F.struct("turn", sym.alias("sym"), F.octet_length(text).cast("long").alias("size"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"))
    head = own.select(F.col("conv_id").alias("base"), F.slice("items", 1, 8).alias("head"))
    based = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).join(head, "base", "left")
    nothing = F.slice("items", 1, 0)
    return based.select("conv_id", F.transform(
        F.concat(F.slice(F.coalesce("head", nothing), F.lit(1), F.col("h")),
                 F.slice("items", F.col("h") + 1, F.size("items"))),
        lambda x: F.struct(x["sym"].alias("sym"), x["size"].alias("size"))).alias("items"))


def joined(items: DataFrame) -> DataFrame:
    """``PATHS``: digests and sizes of the items, each joined to one value."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b"".join(x["sym"] for x in one) for one in lists], pa.binary()),
                 pa.array([b"".join(x["size"].to_bytes(8, "big") for x in one) for one in lists], pa.binary())],
                names=["conv_id", "path", "sizes"])

    return items.mapInArrow(work, PATHS)


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # alike up to low, not up to high + 1
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle * WIDTH] == b[:middle * WIDTH]:
            low = middle
        else:
            high = middle - 1
    return low


@dataclass
class Skeleton:
    """Splitters in order and the trie of their paths: ``nodes[i][d]`` is the node of splitter i's first d turns."""

    splitters: list[tuple[bytes, int]]
    nodes: list[list[int]] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])

    def __post_init__(self) -> None:
        before, last = b"", [0]
        for path, _ in self.splitters:
            own = last[:common(before, path) + 1]
            while len(own) <= len(path) // WIDTH:
                self.parents.append(own[-1])
                own.append(len(self.parents) - 1)
            self.nodes.append(own)
            before, last = path, own

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def along(self, shard: int, path: bytes) -> list[int]:
        """Skeleton nodes of a path in ``shard``, the root first: only the splitters beside it can share its prefixes."""
        best = [0]
        for i in (shard - 1, shard):
            if 0 <= i < len(self.splitters) and (n := common(self.splitters[i][0], path) + 1) > len(best):
                best = self.nodes[i][:n]
        return best


def split(paths: DataFrame, shards: int) -> Skeleton:
    """Splitters for so many shards, evenly spaced in a sample by hash of about ``SAMPLED * shards`` paths."""
    share = min(1.0, SAMPLED * shards / max(1, paths.count()))
    sample = paths.select("path", "conv_id").where(
        F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).collect()
    keys = sorted((bytes(r.path), r.conv_id) for r in sample)
    return Skeleton(sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else [])


class Node:
    """A node while its members pass; ``pending`` holds its finished children until its least member is known."""

    __slots__ = ("conv", "members", "children", "leaves", "saved", "size", "ends", "pending")

    def __init__(self, size: int):
        self.conv, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.size, self.ends, self.pending = size, None, []

    def join(self, conv: int) -> None:
        self.members += 1
        self.conv = conv if self.conv is None else min(self.conv, conv)

    def end(self, conv: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(str(conv).encode())
        else:
            self.ends.update(b",%d" % conv)


class Shard:
    """One sorted shard: rows of ``NODES`` come out of ``add`` and ``close``."""

    def __init__(self, number: int, skeleton: Skeleton):
        self.number, self.skeleton = number, skeleton
        self.path, self.stack, self.base = b"", [], 0  # stack: open nodes off the skeleton, from depth base + 1
        self.partial: dict[int, Node] = {}
        self.lists: dict[int, list[str]] = {}
        self.pieces: dict[int, int] = {}
        self.out: list[tuple] = []

    def _finish(self) -> None:
        """Close the deepest open node."""
        node, depth = self.stack.pop(), self.base + len(self.stack) + 1
        if not node.children:
            node.leaves = 1
        node.saved += (node.members - 1) * node.size
        row = [NODE, node.conv, depth, None, None, node.members, node.children, node.leaves, node.saved,
               node.ends.hexdigest() if node.ends else NONE, None, None, None, None, None]
        for child in node.pending:
            child[3] = node.conv
            self.out.append(tuple(child))
        if self.stack:
            above = self.stack[-1]
            above.pending.append(row)
        else:
            above = self.partial[self.above]
            row[4] = self.above  # its parent's least member is known after the reduction
            self.out.append(tuple(row))
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved

    def _list(self, node: int) -> None:
        """Write the piece of the list of a skeleton node's ends that is held."""
        text = ",".join(self.lists[node])
        self.lists[node] = []
        piece = self.pieces[node] = self.pieces.get(node, -1) + 1
        self.out.append((PIECE, *[None] * 9, node, None, self.number, piece, text))

    def add(self, path: bytes, sizes: bytes, conv: int) -> None:
        alike, depth = common(self.path, path), len(path) // WIDTH
        while self.stack and self.base + len(self.stack) > alike:
            self._finish()
        size = lambda d: int.from_bytes(sizes[8 * d - 8:8 * d], "big") if d else 0
        along = self.skeleton.along(self.number, path)
        if not self.stack:
            self.base, self.above = len(along) - 1, along[-1]
        for d, node in enumerate(along):
            if node not in self.partial:
                self.partial[node] = Node(size(d))
            self.partial[node].join(conv)
        while self.base + len(self.stack) < depth:
            self.stack.append(Node(size(self.base + len(self.stack) + 1)))
        for node in self.stack:
            node.join(conv)
        if self.stack:
            self.stack[-1].end(conv)
        else:
            held_ids = self.lists.setdefault(along[-1], [])
            held_ids.append(str(conv))
            if len(held_ids) * 8 >= ENDS:
                self._list(along[-1])
        self.path = path

    def close(self) -> None:
        while self.stack:
            self._finish()
        for node, ids in self.lists.items():
            if ids:
                self._list(node)
        for number, node in self.partial.items():
            self.out.append((PARTIAL, node.conv, None, None, None, node.members, node.children, node.leaves, node.saved, None,
                             number, node.size, None, None, None))


def sharded(paths: DataFrame, skeleton: Skeleton) -> DataFrame:
    """Rows of ``NODES`` of all shards."""
    spark = paths.sparkSession
    sent = broadcast(spark, skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held(sent)
        for batch in batches:
            to = [known.shard(p, c) for p, c in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], names=["at", *batch.schema.names])

    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "decimal(38,0)": pa.decimal128(38, 0)}
    names, kinds = zip(*(x.split(" ") for x in NODES.split(", ")))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        columns[8] = [None if x is None else Decimal(x) for x in columns[8]]
        return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds)], names=list(names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard = held(sent), None
        for batch in batches:
            at, convs, paths_, sizes = (batch.column(i).to_pylist() for i in range(4))
            out: list[tuple] = []
            for number, conv, path, size in zip(at, convs, paths_, sizes):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                        out += shard.out
                    shard = Shard(number, known)
                shard.add(path, size, conv)
                if len(shard.out) > 4096:
                    yield batch_of(shard.out)
                    shard.out = []
            if out:
                yield batch_of(out)
        if shard is not None:
            shard.close()
            if shard.out:
                yield batch_of(shard.out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = paths.mapInArrow(deal, f"at int, {PATHS}").repartition(parts, "at").sortWithinPartitions("at", "path", "conv_id")
    return dealt.mapInArrow(work, NODES)


def listed(pieces: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of the skeleton nodes where conversations end; a list passes through the digest piece by piece."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for number, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != node:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = number, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])

    ordered = pieces.repartition("node").sortWithinPartitions("node", "shard", "piece").select("node", "ends")
    return ordered.mapInArrow(work, "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of rebuilt conversations.

    ``conv_id`` (least member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.  Conversation c is rebuilt as the first h turns of c - c % 5 (h: crc32 of c's decimals % 9), then its own after
    its first h; ``%`` keeps the sign.  Turns are ordered by turn, null first; equal ones, repeated rows among them, each count and go by
    the digest of role and text.  Null role and text are empty; rows without a conv_id take no part; a very long
    text counts by its digest; an empty table has no node, not even a root; other columns are not read.
    """
    spark = tuned(turns.sparkSession)
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), *[quoted(c) for c in ("turn", "role", "text")])
    paths = saved(joined(paths_of(named)), "trie-paths")
    skeleton = split(paths, shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = saved(sharded(paths, skeleton), "trie-nodes")

    partial = rows.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").cast("decimal(38,0)").alias("saved_tokens"), F.max("size").alias("size"))
    top = finished(partial.collect(), skeleton.parents)  # one row a skeleton node
    schema = "node int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    tops = spark.createDataFrame(top, schema)
    ends = listed(rows.where(F.col("kind") == PIECE))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    of_skeleton = tops.join(ends.withColumn("node", F.col("node").cast("int")), "node", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NONE)))
    above = tops.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    others = rows.where(F.col("kind") == NODE).join(above, "parent_node", "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    out = others.select(*shown).unionByName(of_skeleton.select(*shown))
    return out.select(*[F.col(c) if c == "ends_sha256" else F.col(c).cast("long").alias(c) for c in shown])


def finished(reduced: list, parents: list[int]) -> list[tuple]:
    """Skeleton nodes with their subtrees added up, from the reduced partials of those that have members."""
    own = {r.node: r for r in reduced}
    children, leaves, saved_ = ({n: int(getattr(r, c)) for n, r in own.items()} for c in ("n_children", "n_leaves", "saved_tokens"))
    depth = {}
    for n in sorted(own):  # a parent comes before its children
        depth[n] = depth[parents[n]] + 1 if n else 0
    for n in sorted(own, reverse=True):
        if not children[n]:
            leaves[n] = 1
        saved_[n] += (int(own[n].n_convs) - 1) * int(own[n].size)
        if n:
            children[parents[n]] += 1
            leaves[parents[n]] += leaves[n]
            saved_[parents[n]] += saved_[n]
    return [(n, r.conv_id, depth[n], own[parents[n]].conv_id if n else None, r.n_convs, children[n], leaves[n], saved_[n])
            for n, r in sorted(own.items())]
