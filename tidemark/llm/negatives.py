"""Hard negatives by bounds along spanning trees of the anchors.

Rows become blocks of small matrices, anchors become groups of near neighbours, each with a spanning
tree.  A block meets every group.  At the root of a tree all rows of the block are scored; from then
on a row's score at an anchor lies within its parent's score plus or minus the edge's length times
the row's norm, and only rows whose interval reaches into a window that matters are scored again.
A first pass finds the positives of every anchor, a second the negatives in the windows they set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import quoted, saved, tuned

BLOCK = 4096  # rows scored together
GROUP = 256  # anchors of one tree
PLANES = 16  # directions whose signs bring near anchors together
EXACT = float(2 ** 53)
LONG = 2 ** 63 - 1

PACKED = "block long, n int, dims int, numbers binary, ids binary, labels binary, matrix binary, kind string"


def packed(block: int, ids: list, labels: np.ndarray, matrix: np.ndarray, numbers: np.ndarray) -> tuple:
    """A block as a row of ``PACKED``; whole numbers take as few bytes as hold them all."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 2 ** 15 else "<i4" if most < 2 ** 31 else "<f8"
    known = np.array([i is not None for i in ids], bool)
    values = np.array([0 if i is None else i for i in ids], "<i8")
    return (block, len(ids), matrix.shape[1], numbers.astype("<i8").tobytes(), known.tobytes() + values.tobytes(),
            labels.astype("<i8").tobytes(), np.ascontiguousarray(matrix).astype(kind).tobytes(), kind)


class Block:
    """Rows of one block: row numbers, ids (``known`` where not null), labels, matrix (float64)."""

    def __init__(self, row: dict):
        n = row["n"]
        self.numbers = np.frombuffer(row["numbers"], "<i8")
        self.known = np.frombuffer(row["ids"][:n], bool)
        self.ids = np.frombuffer(row["ids"][n:], "<i8")
        self.labels = np.frombuffer(row["labels"], "<i8")
        self.matrix = np.frombuffer(row["matrix"], row["kind"]).reshape(n, row["dims"]).astype(float)

    def widened(self, dims: int) -> None:
        self.matrix = np.pad(self.matrix, ((0, 0), (0, dims - self.matrix.shape[1])))

    def id_of(self, row: int) -> int | None:
        return int(self.ids[row]) if self.known[row] else None

    def best(self, scores: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
        """The first ``most`` of ``rows`` by score, then id (null last), then row number."""
        if len(rows) > most:  # ties at the edge stay in
            edge = np.partition(scores[rows], len(rows) - most)[len(rows) - most]
            rows = rows[scores[rows] >= edge]
        return rows[np.lexsort((self.numbers[rows], self.ids[rows], ~self.known[rows], -scores[rows]))][:most]


def scaled(vector: list, scale: float) -> np.ndarray:
    return np.floor(np.asarray(vector, float) * scale)


def blocks_of(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """``rows`` (id, label, vector, anchor) as blocks of at most ``size``; shorter vectors are filled up with zeros."""
    schema = f"{PACKED}, anchors binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list = []

        def close() -> pa.RecordBatch:
            nonlocal block
            ids, labels, vectors, anchors = zip(*held)
            matrix = np.zeros((len(held), max(map(len, vectors))))
            for k, v in enumerate(vectors):
                matrix[k, :len(v)] = scaled(v, scale)
            made = packed(block, ids, np.array(labels), matrix, (block << 16) + np.arange(len(held)))
            held.clear()
            block += 1
            return batch_of([(*made, np.array(anchors, bool).tobytes())], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == size:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(work, schema)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)],
                                      names=list(names))


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a least spanning tree from row 0 on; ``parent`` are places in ``order``."""
    n = len(matrix)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, to = np.full(n, np.inf), np.zeros(n, np.int64)
    near[0] = 0
    left = np.ones(n, bool)
    for k in range(n):
        i = int(np.argmin(np.where(left, near, np.inf)))
        order[k], parent[k], edge[k] = i, to[i] if k else -1, near[i]
        left[i] = False
        away = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        closer = left & (away < near)
        near[closer], to[closer] = away[closer], k
    return order, parent, edge


def groups_of(blocks: DataFrame, size: int) -> DataFrame:
    """Groups of near anchors, as such blocks in the order of their tree with ``parents`` and ``edges``."""
    flat = "number long, id long, label long, code long, matrix binary"

    def open_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                mine = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                # Drawn one dimension after another, so a shorter block has the same directions.
                planes = np.random.default_rng(7).standard_normal((b.matrix.shape[1], PLANES))
                code = np.zeros(len(mine), np.int64)
                for bit in (b.matrix[mine] @ planes > 0).T:
                    code = code * 2 + bit
                yield batch_of([(int(b.numbers[k]), b.id_of(k), int(b.labels[k]), int(c), b.matrix[k].tobytes())
                                for k, c in zip(mine, code)], flat)

    near = blocks.mapInArrow(open_block, flat).repartitionByRange("code", "number").sortWithinPartitions("code", "number")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held: list = []

        def close() -> pa.RecordBatch:
            nonlocal number
            vectors = [np.frombuffer(h["matrix"]) for h in held]
            matrix = np.zeros((len(held), max(map(len, vectors))))
            for k, v in enumerate(vectors):
                matrix[k, :len(v)] = v
            order, parent, edge = spanning_tree(matrix)
            made = packed(number, [held[i]["id"] for i in order], np.array([held[i]["label"] for i in order]), matrix[order],
                          np.array([held[i]["number"] for i in order]))
            held.clear()
            number += 1
            return batch_of([(*made, parent.astype("<i8").tobytes(), edge.astype("<f8").tobytes())], f"{PACKED}, parents binary, edges binary")

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == size:
                    yield close()
        if held:
            yield close()

    return near.mapInArrow(grow, f"{PACKED}, parents binary, edges binary")


class Bounds:
    """Intervals of a block's scores at the anchors of a group, exact where a row was scored."""

    def __init__(self, block: Block, group: Block, parents: np.ndarray, edges: np.ndarray):
        dims = max(block.matrix.shape[1], group.matrix.shape[1])
        block.widened(dims)
        group.widened(dims)
        self.block, self.group, self.parents, self.edges = block, group, parents, edges
        self.norms = np.sqrt((block.matrix ** 2).sum(axis=1))
        high = np.abs(block.matrix).max(initial=0) * np.abs(group.matrix).max(initial=0) * dims
        self.plain = high < EXACT
        # Rounding of norms and lengths never narrows an interval.
        self.slack = 1.0 + 1e-9 * float(high)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.scored = 0

    def scores(self, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole scores, and the same as doubles."""
        if self.plain:
            exact = self.block.matrix[rows] @ self.group.matrix[k]
            return exact.astype(np.int64), exact
        whole = [int(x) for x in self.group.matrix[k]]  # beyond what doubles hold: exact, up to the ends of a long
        exact = [sum(int(x) * y for x, y in zip(r, whole)) for r in self.block.matrix[rows]]
        return np.array([max(-LONG, min(LONG, x)) for x in exact], np.int64), np.array(exact, float)

    def visit(self, k: int, wanted) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores at anchor ``k`` of the rows that ``wanted(low, high)`` picks from their intervals: (rows, scores)."""
        if k == 0:
            rows = np.arange(len(self.norms))
            low = high = None
        else:
            reach = self.edges[k] * self.norms * (1 + 1e-9) + self.slack
            low, high = self.low[self.parents[k]] - reach, self.high[self.parents[k]] + reach
            rows = np.flatnonzero(wanted(low, high))
        exact, close = self.scores(k, rows)
        if k == 0:
            low = high = close
        else:
            low[rows] = high[rows] = close
        if not self.plain:
            low, high = low - self.slack, high + self.slack
        self.low.append(low)
        self.high.append(high)
        self.scored += len(rows)
        return rows, exact


def pairs_of(blocks: DataFrame, groups: DataFrame) -> DataFrame:
    """Every block beside every group (columns of groups with ``g_``).

    Blocks are dealt out once into parts, and the groups, a small share of the rows, go to each part.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks.drop("anchors").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")).repartition(parts, "part")
    right = groups.select(*[F.col(c).alias(f"g_{c}") for c in groups.columns],
                          F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).repartition(parts, "part")
    return left.join(right, "part").drop("part")


FOUND = "anchor long, place int, score long, id long, number long"


def searched(pairs: DataFrame, search) -> DataFrame:
    """Rows of ``FOUND`` that ``search(bounds, row)`` finds in every pair of a block and a group."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                group = {c[2:]: v for c, v in row.items() if c.startswith("g_")}
                bounds = Bounds(Block(row), Block(group), np.frombuffer(group["parents"], "<i8"), np.frombuffer(group["edges"], "<f8"))
                found = list(search(bounds, group))
                if found:
                    yield batch_of(found, FOUND)

    return pairs.mapInArrow(work, FOUND)


def found_rows(bounds: Bounds, k: int, place: int, best: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
    b, anchor = bounds.block, int(bounds.group.numbers[k])
    for r in best:
        yield anchor, place, int(scores[r]), b.id_of(r), int(b.numbers[r])


def full(rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, scores.dtype)
    out[rows] = scores
    return out


def find_positives(bounds: Bounds, most: int) -> Iterator[tuple]:
    """The block's first rows of an anchor's label."""
    b = bounds.block
    for k in range(len(bounds.edges)):
        same = (b.labels == bounds.group.labels[k]) & (b.numbers != bounds.group.numbers[k])
        n = int(same.sum())

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if n <= most:
                return same
            sure = np.partition(low[same], n - most)[n - most]  # so many rows score this at least
            return same & (high >= sure)

        rows, exact = bounds.visit(k, wanted)
        scores = full(rows, exact, len(b.ids))
        yield from found_rows(bounds, k, 0, b.best(scores, rows[same[rows]], most), scores)


def windows_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole score with low * positive <= 100 * score <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def find_negatives(bounds: Bounds, windows: list[list[tuple[int, int, int]]], most: int) -> Iterator[tuple]:
    """The block's first rows of other labels in each of an anchor's windows (place, least, greatest score)."""
    b = bounds.block
    for k in range(len(bounds.edges)):
        other = b.labels != bounds.group.labels[k]

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            need = np.zeros(len(low), bool)
            for _, least, greatest in windows[k]:
                inside = other & (high >= least) & (low <= greatest)
                sure = low[inside & (low >= least) & (high <= greatest)]
                if len(sure) > most:  # so many rows of the window score this at least
                    inside &= high >= np.partition(sure, len(sure) - most)[len(sure) - most]
                need |= inside
            return need

        rows, exact = bounds.visit(k, wanted)
        scores = full(rows, exact, len(b.ids))
        rows = rows[other[rows]]
        for place, least, greatest in windows[k]:
            inside = rows[(scores[rows] >= least) & (scores[rows] <= greatest)]
            yield from found_rows(bounds, k, place, b.best(scores, inside, most), scores)


def first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each key by score, id and row number, with ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "number")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256,
                   block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    ``anchor`` is a condition on ``rows`` (null: no).  Components become floor(scale * x); a score is the whole inner
    product.  An anchor's positives are the first ``positives`` other rows of its label; the negatives of
    a positive are the first ``negatives`` rows of other labels with low % to high % of its score.  Higher
    scores come first, ties by smaller id (null last), then by row.  Rows with a null label or vector, or a component
    that is null or not finite, take no part.  Vectors of different lengths are compared as if filled up with zeros
    (an empty one scores 0).  Scores beyond a long stay at its end.  Repeated rows take part each, as anchors too; a row
    is no positive of itself.  Long vectors: a block is
    ``block`` rows whatever their length.  An empty table gives an empty table; other columns are not read.
    """
    tuned(rows.sparkSession)
    sound = rows.select(quoted(id_column).cast("long").alias("id"), quoted(label).cast("long").alias("label"),
                        quoted(vector).cast("array<double>").alias("vector"),
                        F.coalesce(anchor, F.lit(False)).alias("anchor")).where(
        "label is not null and vector is not null").where(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    blocks = saved(blocks_of(sound, block, scale), "negatives-blocks")
    groups = saved(groups_of(blocks, group), "negatives-groups")

    of_anchor = first(searched(pairs_of(blocks, groups), lambda b, row: find_positives(b, positives)), ["anchor"], positives)
    chosen = saved(of_anchor.select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")),
                   "negatives-positives")

    members = "block long, number long, k int, id long"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Block(row)
                yield batch_of([(row["block"], int(x), k, g.id_of(k)) for k, x in enumerate(g.numbers)], members)

    of_group = saved(groups.mapInArrow(listed, members), "negatives-anchors")
    scores = (chosen.join(of_group.withColumnRenamed("number", "anchor"), "anchor").groupBy("block")
              .agg(F.collect_list(F.struct("k", "place", "positive_score")).alias("positives")))

    def windowed(bounds: Bounds, row: dict) -> Iterator[tuple]:
        windows: list = [[] for _ in bounds.edges]
        for p in row["positives"]:
            if p["positive_score"] >= 0:  # else the window is empty
                windows[p["k"]].append((p["place"], *windows_of(p["positive_score"], low, high)))
        return find_negatives(bounds, windows, negatives)

    ready = groups.join(scores, "block")
    mined = first(searched(pairs_of(blocks, ready), windowed), ["anchor", "place"], negatives)
    return (mined.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(chosen, ["anchor", "place"]).join(of_group.select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
