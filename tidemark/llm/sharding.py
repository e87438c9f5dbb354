"""Shards of nearly equal bytes by histogram sort, with DataFrame operations only.

Rows are keyed by a hash of the text, then by a hash of the row and its place, so that equal texts are
neighbours and a group of copies, or of equal rows, is split only where it must be.  Rounds of probes count the exact bytes below
candidate boundaries over all partitions; each round narrows the interval of every boundary until
the bytes below it meet the tolerance.  Rows then move once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import quoted, saved, without

PROBES = 256  # histogram cells of an interval in one round
TOLERANCE = 0.001  # of a shard's bytes
SLOT_ROWS = 50_000  # rows numbered in one task
SPAN = 1 << 62


@dataclass
class Boundary:
    """A splitter being sought: its interval of keys and the bytes below either end."""

    target: float
    low: int
    high: int
    below_low: int
    below_high: int
    group: int | None = None  # the text key inside which the row key is searched
    found: tuple[int, int] | None = None  # (text key, row key): rows before it are below

    def settle(self, key: int) -> None:
        self.found = (key, 0) if self.group is None else (self.group, key)


def _key(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 2)


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the private columns ``__g`` (text key), ``__t`` (row key), ``__size`` (bytes + 1).

    A row's place tells it from equal ones; the keys hold for the table that is written with them.
    """
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    simple = [quoted(f.name) for f in docs.schema.fields
              if f.name != text and isinstance(f.dataType, (T.NumericType, T.StringType, T.BooleanType, T.DateType,
                                                            T.TimestampType, T.BinaryType))]
    return docs.select("*", _key(body, F.lit(1)).alias("__g"), _key(F.lit(2), F.monotonically_increasing_id(), *simple).alias("__t"),
                       (F.octet_length(body).cast("long") + 1).alias("__size"))


def _round(sizes: DataFrame, open_: list[Boundary], tolerance: float) -> None:
    """One job: exact bytes of every cell of every open interval; then each interval narrows."""
    cells: dict[tuple, int] = {}
    for b in open_:
        cells.setdefault((b.group, b.low, b.high), len(cells))
    # A group's interval lies inside another boundary's text interval: the two levels count apart.
    frames = []
    for text_level in (True, False):
        chosen = [(k, n) for k, n in cells.items() if (k[0] is None) == text_level]
        if not chosen:
            continue
        which, cell, key = F.lit(None).cast("int"), F.lit(None).cast("long"), "__g" if text_level else "__t"
        for (group, low, high), number in chosen:
            inside = (F.col(key) >= low) & (F.col(key) < high)
            if group is not None:
                inside = (F.col("__g") == group) & inside
            which = F.when(inside, number).otherwise(which)
            cell = F.when(inside, F.expr(f"({key} - {low}L) div {-(-(high - low) // PROBES)}L")).otherwise(cell)
        frames.append(sizes.select(which.alias("w"), cell.alias("c"), F.col(key).alias("k"), "__size")
                      .where("w is not null").groupBy("w", "c")
                      .agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                           F.min("k").alias("first"), F.max("k").alias("last")))
    counted = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    histogram: dict[int, list] = {}
    for r in counted.collect():  # at most PROBES rows a boundary
        histogram.setdefault(r.w, []).append(r)
    for b in open_:
        below, rows = b.below_low, sorted(histogram.get(cells[(b.group, b.low, b.high)], []), key=lambda r: r.c)
        best = (abs(below - b.target), b.low)
        narrowed = None
        for r in rows:
            above = below + r.bytes
            best = min(best, (abs(above - b.target), r.last + 1))
            if narrowed is None and below <= b.target <= above:
                narrowed = (r, below, above)
            below = above
        if best[0] <= tolerance or narrowed is None or (narrowed[0].first == narrowed[0].last
                                                        and (b.group is not None or narrowed[0].n == 1)):
            b.settle(best[1])
            continue
        r, b.below_low, b.below_high = narrowed
        b.low, b.high = r.first, r.last + 1
        if r.first == r.last:  # one group of copies: search inside it
            b.group, b.low, b.high = r.first, 0, SPAN


def splitters(sizes: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys that cut all rows into ``shards`` runs of nearly equal bytes."""
    total = sizes.agg(F.sum("__size")).first()[0] or 0
    bounds = [Boundary(total * s / shards, 0, SPAN, 0, total) for s in range(1, shards)]
    while open_ := [b for b in bounds if b.found is None]:
        _round(sizes, open_, tolerance * total / shards)
    return sorted(b.found for b in bounds)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", tolerance: float = TOLERANCE,
                    columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shards are of equal bytes within the tolerance, or within one row where a row is
    larger: a very long text is one row, never cut.  Slots number a shard's rows without gaps.  Null texts weigh
    one byte.  Equal texts stay together unless a boundary has to cut their group; equal rows
    likewise.  Ties, rows of one key, go to one side together.  An empty table gives an empty table; columns
    named like the added ones are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    private = ["__g", "__t", "__size", "__cell", "__before"]
    docs = without(docs, private)
    taken = {n.lower() for n in added}
    kept = [c for c in (columns or docs.columns) if c.lower() not in taken]
    body = F.coalesce(quoted(text).cast("string"), F.lit(""))
    # Written once, under plain names: the keys stay as they are whatever is computed again.
    rows = saved(keyed(docs, text).select(
        "__g", "__t", "__size", F.crc32(body.cast("binary")).alias("__crc"),
        *[quoted(c).alias(f"c{i}") for i, c in enumerate(kept)]), "shard-rows")
    sizes = rows.select("__g", "__t", "__size")
    cuts = splitters(sizes, shards, tolerance)
    shard = F.lit(0)
    for g, t in cuts:
        shard = shard + ((F.col("__g") > g) | ((F.col("__g") == g) & (F.col("__t") >= t))).cast("int")
    cells = sizes.count() // (shards * SLOT_ROWS) + 1
    cell = F.pmod(F.xxhash64("__g", "__t"), F.lit(cells))
    before = (sizes.groupBy(shard.alias("shard"), cell.alias("__cell")).count()
              .withColumn("__before", F.sum("count").over(Window.partitionBy("shard").orderBy("__cell")) - F.col("count"))
              .drop("count"))
    placed = rows.select("*", F.lit("bytes").alias("law"), shard.alias("shard"), cell.alias("__cell"))
    number = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__g", "__t"))
    return (placed.join(before, ["shard", "__cell"])
            .withColumn("slot", (F.col("__before") + number - 1).cast("long"))
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("__size").alias("size"),
                    F.col("__crc").alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))
