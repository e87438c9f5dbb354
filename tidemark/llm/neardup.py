"""Near-duplicate classes by DartMinHash.

A document is the weighted set of its five-word shingles (weight: occurrences), of words without
regard to A-Z case and the marks that end a clause.  Each element's
weight region is hit by darts that depend on the element alone; a dart has a height in the region, a
rank, and one of K coordinates.  The earliest dart within the weight is kept per coordinate, so two
documents agree on a coordinate with probability their weighted Jaccard similarity.  Only about
K log K darts are thrown a document beyond one look at each element.

Bands of coordinates are joined.  In every bucket the member with most neighbours is compared with
the others, exactly, on their shingles: a constant number of pairs a member.  The members of buckets that
still hold several classes are then compared with one another where they are few, and else joined exactly:
texts near one another share a shingle among the rarest of each, at places that leave room for the rest (prefix and position filter).  Pairs of one class are
passed over; where many are left they are compared in parts, and classes joined in between.
No link between members of a bucket that lie in different classes is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast, bytes_of, quoted, saved
from tidemark.llm.common import held as unpacked
from tidemark.llm.words import LOWER, WordHashes, mix, runs

SHINGLE = 5
MARKS = b".,;:!?"
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SMALL = 16  # members of a bucket whose pairs are all compared
CELLS = 19  # bits: cells in which shingles are counted, only to put rare ones first
PART, LEAST_PART = 16, 200_000  # pairs a text compared at a time, or so many in all
SLICES = 1 << 20  # pairs are dealt by hash; a part is a range of these
SLACK = 1e-6  # filters are wider by this than the threshold in floating point
CHUNK = 400_000  # cells of the dart board worked on at a time

# Poisson(1) by inversion: number of darts in a cell of unit area.
POISSON = np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880], float))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray,
          k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of ranks [low, high) (per document) in the regions of ``element`` x ``weight``.

    Returns document * k + coordinate, rank and dart id of those that hit.  The board's cells are one
    unit of weight by one unit of rank.
    """
    first = np.floor(low[doc]).astype(np.int64)
    tall = np.ceil(high[doc]).astype(np.int64) - first
    wide = np.ceil(weight).astype(np.int64)
    n = wide * tall
    at = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    column, row = inside // tall[at], first[at] + inside % tall[at]
    cell = mix(element[at] + mix((column.astype(np.uint64) << np.uint64(32)) + row.astype(np.uint64) + np.uint64(1)))
    darts = np.searchsorted(POISSON, unit(mix(cell + np.uint64(1))), side="right")
    dart = np.repeat(np.arange(len(cell)), darts)
    number = np.arange(len(dart)) - np.repeat(np.cumsum(darts) - darts, darts)
    ids = mix(cell[dart] + mix(number.astype(np.uint64) + np.uint64(7)))
    rank = row[dart] + unit(mix(ids + np.uint64(11)))
    place = column[dart] + unit(mix(ids + np.uint64(13)))
    own = doc[at[dart]]
    hit = (place < weight[at[dart]]) & (rank >= low[own]) & (rank < high[own])
    coordinate = own * k + (mix(ids + np.uint64(17)) % np.uint64(k)).astype(np.int64)
    return coordinate[hit], rank[hit], ids[hit]


def sketch(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """DartMinHash signatures (documents x k) of non-empty weighted sets."""
    out = np.zeros((len(sets), k), np.uint64)
    flat = out.reshape(-1)
    begin = 0
    darts_wanted = k * np.log(k) + 2 * k
    while begin < len(sets):
        end, cells = begin, 0
        while end < len(sets) and (end == begin or cells < CHUNK):
            cells += int(np.ceil(sets[end][1]).sum() + darts_wanted)
            end += 1
        todo = np.arange(begin, end)
        total = np.array([sets[i][1].sum() for i in todo])
        low, high = np.zeros(len(todo)), darts_wanted / total
        while len(todo):
            doc = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
            where, rank, ids = throw(doc, np.concatenate([sets[i][0] for i in todo]),
                                     np.concatenate([sets[i][1] for i in todo]).astype(float), low, high, k)
            order = np.argsort(-rank, kind="stable")
            where, ids = where[order], ids[order]
            got = np.zeros(len(todo) * k, np.uint64)
            got[where] = ids  # the last written, that is the earliest dart, stays
            got = got.reshape(len(todo), k)
            blank = out[todo] == 0
            out[todo] = np.where(blank, got, out[todo])
            left = (out[todo] == 0).any(axis=1)  # a coordinate without a dart: throw the next ranks
            todo, low, high = todo[left], high[left], 2 * high[left]
        begin = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures[:, :bands * rows].reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted arrays of shingles with repeats."""
    if not len(a) and not len(b):
        return 1.0
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(a) + len(b) - common)


def sketches(docs: DataFrame, text: str, bands: int, rows: int, columns: list[str]) -> DataFrame:
    """``columns``, ``node`` (128-bit digest of the text), ``keys`` of the bands and ``shingles`` (sorted 32-bit hashes)."""
    body = bytes_of(text)
    source = docs.select(F.struct(F.lit(0).alias("__"), *[quoted(c) for c in columns]).alias("row"),
                         F.unhex(F.md5(body)).alias("node"), body.alias("body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            grams = [runs(hashes.of(b.translate(LOWER, MARKS).split()), SHINGLE) for b in batch.column(2).to_pylist()]
            sets = [np.unique(g, return_counts=True) for g in grams]
            filled = [i for i, g in enumerate(grams) if len(g)]
            keys: list = [[]] * len(grams)
            if filled:
                signatures = sketch([sets[i] for i in filled], bands * rows)
                made = band_keys(signatures, bands, rows).view(np.int64)
                for i, row in zip(filled, made):
                    keys[i] = row
            small = [np.sort((g >> np.uint64(32)).astype("<u4")).tobytes() for g in grams]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(small, pa.binary())], names=["row", "node", "keys", "shingles"])

    return source.mapInArrow(work, f"row {source.schema['row'].dataType.simpleString()}, node binary, "
                                   "keys array<long>, shingles binary")


def _compared(pairs: DataFrame, shingles: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` (a, b) with ``similar``, by the exact similarity of the shingles."""
    left = shingles.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = shingles.select(F.col("node").alias("b"), F.col("shingles").alias("right"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= threshold
                     for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())],
                                             names=["a", "b", "similar"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(work, "a binary, b binary, similar boolean")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, label`` of every node of ``edges`` (a, b): the least node of its component.

    Alternates large-star and small-star steps; edges and labels stay distributed.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first())

    seen = None
    while (mark := state(now)) != seen:
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        under = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(under, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(under.select("u", F.col("m").alias("v"))))
        now = saved(small.where("u <> v").distinct(), name)
    return now.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")


def relabelled(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """``labels`` (node, label) after ``edges`` (a, b) have joined classes; a node without a label is its own."""
    if edges.isEmpty():
        return labels
    if labels is None:
        return saved(components(edges, "neardup-edges"), "neardup-labels")
    for end in ("a", "b"):
        own = labels.select(F.col("node").alias(end), F.col("label").alias("of"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    moved = components(edges, "neardup-edges")  # of labels, which have no label themselves
    new = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return saved(labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(moved), "neardup-labels")


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def led(held: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every member with the one of its bucket that has most neighbours."""
    lead = (held.groupBy("key").agg(F.min(F.struct((-F.col("degree")).alias("d"), "node", "size")).alias("lead"))
            .select("key", F.col("lead.node").alias("other"), F.col("lead.size").alias("other_size")))
    close = F.least("size", "other_size") >= threshold * F.greatest("size", "other_size")
    return held.join(lead, "key").where("node <> other").where(close).select(*_pair("node", "other"))


def unsettled(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (``key, node, size, label``) of buckets that hold several classes, and ``small``: of few members."""
    now = _labelled(held.select("key", "node", "size"), labels)
    several = (now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
               .where("low <> high").select("key", (F.col("n") <= SMALL).alias("small")))
    return now.join(several, "key")


def within(small: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of different classes in a bucket."""
    other = small.select("key", *[F.col(c).alias("o_" + c) for c in ("node", "size", "label")])
    close = F.least("size", "o_size") >= threshold * F.greatest("size", "o_size")
    return small.join(other, "key").where("node < o_node and label <> o_label").where(close).select(*_pair("node", "o_node"))


def told_apart(shingles: bytes) -> np.ndarray:
    """Sorted shingles as a set: the occurrence of each is part of it."""
    s = np.frombuffer(shingles, "<u4")
    return s.astype(np.uint64) << np.uint64(32) | (np.arange(len(s)) - np.searchsorted(s, s)).astype(np.uint64)


def _cells(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> np.uint64(64 - CELLS)).astype(np.int64)


def prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """``node``, ``size``, ``head`` and the ``elements`` that come first in one order of all, the rarest first.

    Any order is exact.  A text shares one of its ``elements`` with every larger or smaller text
    near it, and one of the first ``head`` with every one not smaller.
    """
    spark = texts.sparkSession
    bare = texts.select("shingles")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, _cells(told_apart(s)), 1)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 50_000):
            part = used[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["cell", "n"])

    found = bare.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weight = np.zeros(1 << CELLS, np.int64)
    weight[found["cell"].to_numpy()] = found["n"].to_numpy()
    sent = broadcast(spark, weight)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = unpacked(sent)
        for batch in batches:
            sizes, heads, firsts = [], [], []
            for s in batch.column(1).to_pylist():
                own = told_apart(s)
                n = len(own)
                kept = n - int(np.ceil(threshold * n - SLACK)) + 1
                sizes.append(n)
                heads.append(n - int(np.ceil(2 * threshold / (1 + threshold) * n - SLACK)) + 1)
                firsts.append(own[np.lexsort((mix(own), common[_cells(own)]))[:kept]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
                names=["node", "size", "head", "elements"])

    return texts.select("node", "shingles").mapInArrow(work, "node binary, size long, head long, elements array<long>")


def contested(firsts: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``element``, ``at``, ``node``, ``size``, ``head``, ``label`` of elements that several classes have, and ``inside``:
    of the class that has an element most often."""
    rows = _labelled(firsts, labels).select("node", "size", "head", "label", F.posexplode("elements").alias("at", "element"))
    state = (rows.groupBy("element", "label").agg(F.count(F.lit(1)).alias("c"))
             .groupBy("element").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("c", "label")).alias("large"))
             .where("classes > 1").select("element", F.col("large.label").alias("large")))
    return rows.join(state, "element").withColumn("inside", F.col("label") == F.col("large")).drop("large")


def rivals(rows: DataFrame, threshold: float, low: int) -> DataFrame:
    """(a, b, slice), with repeats: pairs of different classes that may be near, from slice ``low`` on."""
    other = rows.select("element", *[F.col(c).alias("o_" + c) for c in ("at", "node", "size", "label", "inside")])
    room = F.least(F.col("size") - F.col("at"), F.col("o_size") - F.col("o_at"))
    first = rows.where("at < head")
    slice_ = F.expr(f"pmod(xxhash64(node, o_node), {SLICES})")
    near = ((F.col("label") != F.col("o_label"))
            & ((F.col("size") < F.col("o_size")) | ((F.col("size") == F.col("o_size")) & (F.col("node") < F.col("o_node"))))
            & (F.col("size") >= threshold * F.col("o_size") - SLACK)
            & (room >= threshold / (1 + threshold) * (F.col("size") + F.col("o_size")) - SLACK) & (slice_ >= low))
    # Pairs within the class that has an element most often are never made.
    made = first.where("not inside").join(other, "element").where(near).unionByName(
        first.where("inside").join(other.where("not o_inside"), "element").where(near))
    return made.select(*_pair("node", "o_node"), slice_.alias("slice"))


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", threshold: float = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``class_id`` (least id of the class) and ``n_links``.

    ``n_links`` counts links found between a row's text and other texts.  Equal texts share a class;
    null and empty texts are equal to each other and to nothing else, nor is a text of marks alone near another; texts of fewer than five words
    are one shingle; repeated rows are kept each; a very long text is one set of shingles, whole, in one task.  Null ids rank last.  An empty table gives an empty
    table; columns named like the added ones are replaced.
    """
    kept = [c for c in (columns or docs.columns) if c.lower() not in ("class_id", "n_links")]
    needed = list(dict.fromkeys([*kept, id_column]))
    drawn = saved(sketches(docs, text, bands, rows, needed), "neardup-sketches")
    whole = drawn.select("node", "keys").where(F.size("keys") > 0)
    # Equal texts have equal keys: one entry a text and bucket, whatever the copies.
    entries = whole.select("node", F.explode("keys").alias("key")).distinct()
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = saved(entries.join(shared, "key"), "neardup-members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    involved = degree.select("node")
    shingles = saved(drawn.select("node", "shingles").join(involved, "node", "left_semi").dropDuplicates(["node"]),
                     "neardup-shingles")
    size = shingles.select("node", F.octet_length("shingles").alias("size"))
    held = saved(members.join(degree, "node").join(size, "node").select("key", "node", "degree", "size"), "neardup-ranked")

    def linked(pairs: DataFrame) -> DataFrame:
        return saved(_compared(pairs, shingles, threshold).where("similar").select("a", "b"), "neardup-near")

    found = linked(led(held, threshold).distinct())
    labels = relabelled(None, found)
    now = saved(unsettled(held, labels), "neardup-unsettled")
    near = linked(within(now.where("small"), threshold).distinct())
    found = found.unionByName(near)
    labels = relabelled(labels, near)
    large = unsettled(held, labels).where("not small").select("node").distinct()
    rest = saved(shingles.join(large, "node", "left_semi"), "neardup-rest")
    n = rest.count()
    if n:
        firsts, low = saved(prefixes(rest, threshold), "neardup-prefixes"), 0
        while low < SLICES:
            left = rivals(saved(contested(firsts, labels), "neardup-contested"), threshold, low)
            many = left.count()
            if not many:
                break
            high = min(SLICES, low + max(1, (SLICES - low) * max(LEAST_PART, PART * n) // many))
            near = linked(left.where(F.col("slice") < high).select("a", "b").distinct())
            found = found.unionByName(near)
            labels, low = relabelled(labels, near), high

    member = drawn.select("node", F.col("row")[id_column].alias("id"))
    if labels is None:
        texts = drawn.groupBy("node").agg(F.min(F.col("row")[id_column]).alias("class_id")).withColumn("n_links", F.lit(0).cast("long"))
    else:
        edges = found.distinct()
        links = (edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
                 .groupBy("node").agg(F.count(F.lit(1)).alias("n_links")))
        texts = (member.groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").join(links, "node", "left")
                 .select("node", "id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
        texts = texts.join(texts.groupBy("label").agg(F.min("id").alias("class_id")), "label").select("node", "class_id", "n_links")
    return (drawn.select("node", "row").join(texts, "node")
            .select(*[F.col("row")[c].alias(c) for c in kept], "class_id", "n_links"))
