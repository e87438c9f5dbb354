"""Bounded-space online best-fit packing of token sequences.

A fixed number of bins is open at a time, kept in lists by the space they have left, with one bit of
an integer for each space that occurs.  A piece goes to the fullest bin that holds it: the lowest bit
at or above its length.  If none does, a new bin opens, and where that is one too many, the fullest
closes first.  Pieces come in runs of bounded length, the longest of a run first, which leaves
the short ones to fill up.  A placed piece is written, so a task holds one run of pieces and, of the
open bins, numbers alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import quoted
from tidemark.llm.packing import encoder_of

OPEN_BINS = 2048
RUN = 2048  # pieces that are put in order before they are placed


class OpenBins:
    """At most ``most`` open bins of ``length``; ``place`` gives a piece's bin and offset."""

    def __init__(self, length: int, most: int = OPEN_BINS, first: int = 0):
        self.length, self.most, self.next = length, most, first
        self.by_space: dict[int, list[int]] = {}
        self.spaces = 0  # bit s: a bin with s left
        self.count = 0

    def _take(self, space: int) -> int:
        """The bin opened or filled last of those with ``space`` left."""
        bins = self.by_space[space]
        number = bins.pop()
        if not bins:
            self.spaces ^= 1 << space
        self.count -= 1
        return number

    def _keep(self, number: int, space: int) -> None:
        if space:
            self.by_space.setdefault(space, []).append(number)
            self.spaces |= 1 << space
            self.count += 1

    def place(self, size: int) -> tuple[int, int]:
        fits = self.spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.length, self.next
            self.next += 1
            if size < space and self.count == self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
        self._keep(number, space - size)
        return number, self.length - space


def cut(total: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens: all of ``length``, but the first may be shorter."""
    first = total % length or min(total, length)
    return [(0, first), *((at, length) for at in range(first, total, length))] if total else []


def pack_best_fit(docs: DataFrame, tokenizer_file: str, length: int = 1024, open_bins: int = OPEN_BINS, run: int = RUN,
                  end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ids and an end id in sequences of at most ``length`` tokens.

    Returns per piece ``doc_id, piece, start, length, ids`` (little-endian 32-bit), ``sequence_id, offset``.
    Documents of up to ``length`` tokens stay whole; only the first piece of a longer one may be short.
    Null and empty texts are the end id alone.  Ties: equal lengths as they come, into the bin used last of
    those with equal space.  Repeated rows are packed each; a null id stays null; very long texts are encoded whole, one at
    a time; an empty table gives an empty table; only the two named columns are read, so others may have any names.  Rows are packed
    where they lie, without a shuffle: each task ends with at most ``open_bins`` bins that are not full.
    """
    names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer_file), np.uint32(end_id).astype("<u4").tobytes()
        bins = OpenBins(length, open_bins, TaskContext.get().partitionId() << 40)
        waiting: list[tuple] = []

        def placed() -> pa.RecordBatch:
            waiting.sort(key=lambda piece: -piece[3])
            out = [(*piece, *bins.place(piece[3])) for piece in waiting]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(body) + end
                for piece, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    waiting.append((doc, piece, start, size, ids[4 * start:4 * (start + size)]))
                    if len(waiting) == run:
                        yield placed()
        if waiting:
            yield placed()

    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"),
                       F.coalesce(quoted(text).cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(work, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long")
