"""Language-model scores from a log-frequency Bloom filter.

Spark counts the words and word pairs of all training documents, hashed to 64 bits.  An n-gram of
quantised count q goes into the filter as (n-gram, 1) ... (n-gram, q); probing level after level
until one is missing gives the count back, never too low.  The filter has a fixed number of bits and
is broadcast; it is cut in as many segments as the counting has cells, so each cell's task fills one
segment and nothing else is exchanged.  The lowest levels that do not fit stay out of the filter: tokens
whose word, context or pair the filter does not know are then joined with the counts of those levels, so
that every n-gram counts.  The exact counts behind ``base_score`` and ``n_known`` keep every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast, bytes_of, held, quoted, saved
from tidemark.llm.words import LOWER, ODD, WordHashes, mix

END = b" "  # no word holds a space
FOLDS, HELD_OUT = 7, 2
BASE = 1.5  # quantisation: level l stands for counts from BASE^(l-1) up to BASE^l
FILTER_BITS = 1 << 28
PROBES = 4
BITS_AN_ENTRY = 8
HEAD = 1 << 19  # words whose exact counts are broadcast; the others are joined
STRENGTH = 1000.0  # of the unigram prior in a context
CELL_BYTES = 8_000_000  # training text behind one counting cell
FLUSH = 1_200_000  # n-grams a task gathers before it sends their counts
KNOWN = 300_000  # words a scoring task remembers
LEVELS = 96
UNKNOWN = 255  # a level that is looked up below the filter


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64) + 1


def count_of_level() -> np.ndarray:
    """Mean of the counts that a level stands for; 0 for level 0."""
    edge = BASE ** np.arange(LEVELS + 1)
    low, high = np.ceil(edge[:-1] - 1e-9), np.ceil(edge[1:] - 1e-9) - 1
    return np.r_[0.0, (low + np.maximum(low, high)) / 2]


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * ODD + second + np.uint64(2))


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def places(hashes: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    """Where a probe of (n-gram, level) looks in its segment."""
    salt = mix(np.full(1, level * PROBES + probe + 1, np.uint64) * ODD)
    return mix(hashes ^ salt) & np.uint64(bits - 1)


def count_ngrams(training: DataFrame, cells: int) -> DataFrame:
    """One row a cell of the hash space: sorted hashes and counts of its words and pairs.

    ``cell, hashes1, counts1, hashes2, counts2, levels1, levels2, total, distinct``.
    """
    shift = np.uint64(64 - (cells.bit_length() - 1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        end = hashes.of([END])
        parts: dict[int, list] = {1: [], 2: []}
        waiting = 0

        def merged(order: int) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in parts[order]])
            sums = np.concatenate([c for _, c in parts[order]])
            at = np.argsort(keys)
            keys, sums = keys[at], sums[at]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[starts], np.add.reduceat(sums, starts)

        def send() -> Iterator[pa.RecordBatch]:
            for order in (1, 2):
                if parts[order]:
                    keys, sums = merged(order)
                    cell = (keys >> shift).astype(np.int64) if cells > 1 else np.zeros(len(keys), np.int64)
                    own, starts = np.unique(cell, return_index=True)
                    ends = np.r_[starts[1:], len(keys)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.astype(np.int32)), pa.array([order] * len(own), pa.int32()),
                         pa.array([keys[a:b].astype("<u8").tobytes() for a, b in zip(starts, ends)], pa.binary()),
                         pa.array([sums[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)], pa.binary())],
                        names=["cell", "order", "hashes", "counts"])
                parts[order] = []

        for batch in batches:
            flat = [end]
            for body in batch.column(0).to_pylist():
                flat += [hashes.of(body.translate(LOWER).split()), end]
            h = np.concatenate(flat)
            for order, grams in ((1, h[1:]), (2, pair_hash(h[:-1], h[1:]))):
                keys, sums = np.unique(grams, return_counts=True)
                parts[order].append((keys, sums))
                waiting += len(keys)
            if waiting > FLUSH:
                for order in (1, 2):
                    parts[order] = [merged(order)]
                waiting = sum(len(parts[order][0][0]) for order in (1, 2))
                if waiting > FLUSH // 2:
                    yield from send()
                    waiting = 0
        yield from send()

    def merge(group: pa.Table) -> pa.Table:
        out: dict[str, list] = {"cell": [group["cell"][0].as_py()]}
        for order in (1, 2):
            rows = group.filter(pa.compute.equal(group["order"], order))
            keys = np.frombuffer(b"".join(rows["hashes"].to_pylist()), "<u8")
            sums = np.frombuffer(b"".join(rows["counts"].to_pylist()), "<u4").astype(np.int64)
            keys, inverse = np.unique(keys, return_inverse=True)
            totals = np.bincount(inverse, sums, len(keys)).astype(np.int64)
            out[f"hashes{order}"] = [keys.astype("<u8").tobytes()]
            out[f"counts{order}"] = [totals.astype("<u8").tobytes() if order == 1 else np.minimum(totals, 2**32 - 1).astype("<u4").tobytes()]
            out[f"levels{order}"] = [np.bincount(level_of(totals), minlength=LEVELS + 1).tolist() if len(keys) else [0] * (LEVELS + 1)]
            if order == 1:
                out["total"], out["distinct"] = [int(totals.sum())], [len(keys)]
        types = {"cell": pa.int32(), "hashes1": pa.binary(), "counts1": pa.binary(), "hashes2": pa.binary(), "counts2": pa.binary(),
                 "levels1": pa.list_(pa.int64()), "levels2": pa.list_(pa.int64()), "total": pa.int64(), "distinct": pa.int64()}
        return pa.table({k: pa.array(out[k], t) for k, t in types.items()})

    sent = training.mapInArrow(gather, "cell int, order int, hashes binary, counts binary")
    return sent.groupBy("cell").applyInArrow(
        merge, "cell int, hashes1 binary, counts1 binary, hashes2 binary, counts2 binary, levels1 array<long>, "
               "levels2 array<long>, total long, distinct long")


def lowest_levels(levels1: list[int], levels2: list[int], bits: int) -> tuple[int, int]:
    """The lowest level of words and of pairs that the filter has room for, words first (half the room); those below are joined."""
    def fitting(levels: list[int], room: float) -> int:
        above = np.cumsum(levels[::-1])[::-1]  # n-grams that reach a level
        entries = np.cumsum(above[::-1])[::-1]  # entries from a level up
        fits = np.flatnonzero(entries[1:] <= room)
        return int(fits[0]) + 1 if len(fits) else LEVELS

    room = bits / BITS_AN_ENTRY
    first = fitting(levels1, room / 2)
    used = sum(n * max(0, q - first + 1) for q, n in enumerate(levels1))
    return first, fitting(levels2, room - used)


class FrequencyFilter:
    """The broadcast filter: quantised counts by membership probes."""

    def __init__(self, bits: np.ndarray, cells: int, lowest: tuple[int, int], words: int, distinct: int):
        self.bits, self.cells, self.lowest = bits, cells, lowest
        self.segment = len(bits) * 8 // cells
        self.words, self.distinct = words, distinct
        self.counts = count_of_level()

    def has(self, hashes: np.ndarray, level: int) -> np.ndarray:
        shift = np.uint64(64 - (self.cells.bit_length() - 1))
        start = (hashes >> shift if self.cells > 1 else np.zeros_like(hashes)) * np.uint64(self.segment)
        found = np.ones(len(hashes), bool)
        for probe in range(PROBES):
            at = start + places(hashes, level, probe, self.segment)
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def count(self, hashes: np.ndarray, order: int) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        level = self.lowest[order - 1]
        while len(left) and level <= LEVELS:
            left = left[self.has(hashes[left], level)]
            out[left] = level
            level += 1
        return self.counts[out]


def build_filter(cells_table: DataFrame, cells: int, bits: int) -> tuple[FrequencyFilter, np.ndarray, np.ndarray, int]:
    """The filter, the exact counts of the most frequent words (hashes, counts), and the level below which words are not among them."""
    sums = cells_table.agg(F.sum("total"), F.sum("distinct"),
                           *[F.sum(F.col(f"levels{o}")[i]) for o in (1, 2) for i in range(LEVELS + 1)]).first()
    words, distinct = sums[0] or 0, sums[1] or 0
    levels1 = [int(x or 0) for x in sums[2:3 + LEVELS]]
    levels2 = [int(x or 0) for x in sums[3 + LEVELS:]]
    lowest = lowest_levels(levels1, levels2, bits)
    reach = np.cumsum(levels1[::-1])[::-1]
    head = int(np.flatnonzero(np.r_[reach, 0] <= HEAD)[0])
    segment = bits // cells

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mask = np.zeros(segment, bool)
                for order, kind in ((1, "<u8"), (2, "<u4")):
                    h = np.frombuffer(row[f"hashes{order}"], "<u8")
                    q = level_of(np.frombuffer(row[f"counts{order}"], kind).astype(float))
                    level = lowest[order - 1]
                    while len(h := h[q >= level]):
                        q = q[q >= level]
                        for probe in range(PROBES):
                            mask[places(h, level, probe, segment).astype(np.int64)] = True
                        level += 1
                h, c = np.frombuffer(row["hashes1"], "<u8"), np.frombuffer(row["counts1"], "<u8")
                top = level_of(c.astype(float)) >= head if len(c) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["cell"]], pa.int32()), pa.array([np.packbits(mask, bitorder="little").tobytes()], pa.binary()),
                     pa.array([h[top].tobytes()], pa.binary()), pa.array([c[top].tobytes()], pa.binary())],
                    names=["cell", "bits", "hashes", "counts"])

    whole = np.zeros(bits // 8, np.uint8)
    hashes, counts = [np.zeros(0, "<u8")], [np.zeros(0, "<u8")]
    for r in cells_table.mapInArrow(fill, "cell int, bits binary, hashes binary, counts binary").toLocalIterator():
        whole[r.cell * segment // 8:(r.cell + 1) * segment // 8] = np.frombuffer(r.bits, np.uint8)
        hashes.append(np.frombuffer(r.hashes, "<u8"))
        counts.append(np.frombuffer(r.counts, "<u8"))
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    return FrequencyFilter(whole, cells, lowest, words, distinct), h[order], c[order], head


def below_filter(counted: DataFrame, order: int, lowest: int) -> DataFrame:
    """``at, level``: hashes and levels of the n-grams that the filter has no room for."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, q = np.frombuffer(h, "<u8"), level_of(np.frombuffer(c, "<u8" if order == 1 else "<u4").astype(float))
                low = q < lowest
                yield pa.RecordBatch.from_arrays([pa.array(h[low].view(np.int64)), pa.array(q[low].astype(np.int32))], names=["at", "level"])

    return counted.select(f"hashes{order}", f"counts{order}").mapInArrow(work, "at long, level int")


def scores_by_join(scored: DataFrame, counted: DataFrame, model: FrequencyFilter, strength: float) -> DataFrame:
    """``row, late``: the log probabilities of a row's ``open`` tokens, whose unknown levels are looked up below the filter.

    ``code`` packs how often a token occurs in the row and the levels of pair, word and context, so that little is shuffled.
    """
    def level(shift: int) -> Column:
        return F.shiftright("code", shift).bitwiseAND(255)

    def count(shift: int) -> Column:
        return F.element_at(F.array(*map(F.lit, model.counts.tolist())), (level(shift) + 1).cast("int"))

    tokens = scored.select("row", F.inline("open"))
    for order, key, shift in ((2, "pair", 16), (1, "word", 8), (1, "context", 0)):
        lowest = model.lowest[order - 1]
        if lowest > 1:  # tokens with nothing to look up keep out of one another's way by their pair
            own = F.col(key) if key == "pair" else F.when(level(shift) == UNKNOWN, F.col(key)).otherwise(F.col("pair"))
            found = F.shiftleft(F.coalesce("level", F.lit(0)).cast("long") - UNKNOWN, shift)
            tokens = tokens.join(below_filter(counted, order, lowest), own == F.col("at"), "left").withColumn(
                "code", F.when(level(shift) == UNKNOWN, F.col("code") + found).otherwise(F.col("code"))).drop("at", "level")
    space = float(model.words + model.distinct + 1)
    p = (F.least(count(16), count(8), count(0)) + strength * (count(8) + 1) / space) / (count(0) + strength)
    return tokens.groupBy("row").agg(F.sum(F.shiftright("code", 24) * F.log10(p)).alias("late"))


def score_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", filter_bits: int = FILTER_BITS,
                    strength: float = STRENGTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row.

    The model learns from rows that are not held out.  Null and empty texts are one end token;
    repeated rows are scored (and learnt) each; an empty table gives an empty table; other columns
    are not read.  P(word | previous) = (pair + s * P(word)) / (previous + s), s the strength, all
    counts from the filter or, below its lowest level, quantised alike by a join.
    """
    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), is_held_out(quoted(id_column)).alias("held_out"),
                       bytes_of(text).alias("body"))
    training = rows.where(~F.col("held_out")).select("body")
    size = training.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells = 64
    while cells * CELL_BYTES < size and cells * 1024 < filter_bits:
        cells *= 2
    counted = saved(count_ngrams(training, cells), "lm-cells")
    model, head_hashes, head_counts, head_level = build_filter(counted, cells, filter_bits)
    sent = broadcast(docs.sparkSession, (model, head_hashes, head_counts))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hh, hc = held(sent)
        hashes = WordHashes()
        row = TaskContext.get().partitionId() << 40
        space = model.words + model.distinct + 1.0
        ids: dict[bytes, int] = {}
        h = np.zeros(0, np.uint64)
        seen, exact = np.zeros(0), np.zeros(0, np.int64)
        unknown = [-1.0 if level > 1 else 0.0 for level in model.lowest]  # -1: may be below the filter
        for batch in batches:
            bodies = [b.translate(LOWER).split() + [END] for b in batch.column(2).to_pylist()]
            if not bodies:
                continue
            if len(ids) > KNOWN:
                ids.clear()
                h, seen, exact = h[:0], seen[:0], exact[:0]
            new = list(set().union((END,), *bodies).difference(ids))
            if new:
                ids.update(zip(new, range(len(ids), len(ids) + len(new))))
                fresh = hashes.of(new)
                c = model.count(fresh, 1)
                h, seen = np.r_[h, fresh], np.r_[seen, np.where(c == 0, unknown[0], c)]
                if len(hh):
                    at = np.minimum(np.searchsorted(hh, fresh), len(hh) - 1)
                    exact = np.r_[exact, np.where(hh[at] == fresh, hc[at].astype(np.int64), -1)]
                else:
                    exact = np.r_[exact, np.full(len(fresh), -1)]
            lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
            word = np.fromiter(map(ids.__getitem__, chain.from_iterable(bodies)), np.int64, int(lengths.sum()))
            before = np.r_[ids[END], word[:-1]]
            starts = np.cumsum(lengths) - lengths
            c1, ch = seen[word], seen[before]
            learnt = np.repeat(~np.asarray(batch.column(1).to_pylist(), bool), lengths)
            if model.lowest[0] == 2:  # what a training text holds occurs, and once where it does not reach level 2
                c1, ch = (np.where((c < 0) & learnt, model.counts[1], c) for c in (c1, ch))
            c2 = model.count(pair_hash(h[before], h[word]), 2)
            if model.lowest[1] == 2:
                c2 = np.where((c2 == 0) & learnt, model.counts[1], c2)
            c2 = np.where((c2 == 0) & (c1 != 0) & (ch != 0), unknown[1], c2)
            later = np.minimum(np.minimum(c1, ch), c2) < 0
            p = (np.minimum(c2, np.minimum(c1, ch)) + strength * (c1 + 1) / space) / (ch + strength)
            scores = np.add.reduceat(np.log10(np.where(later, 1.0, p)), starts)
            e = exact[word]
            sure = np.add.reduceat(np.where(e >= 0, np.log10(np.maximum(e, 0) + 1), 0.0), starts)
            known = np.add.reduceat((e > 0).astype(np.int64), starts)
            rare = np.flatnonzero(e < 0)
            doc = np.searchsorted(starts, rare, side="right") - 1
            pair = doc * len(h) + word[rare]
            pair, times = np.unique(pair, return_counts=True)
            owner = pair // max(1, len(h))
            offsets = np.searchsorted(owner, np.arange(len(bodies) + 1)).astype(np.int32)
            tail = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
                [pa.array(h[pair % max(1, len(h))].view(np.int64)), pa.array(times.astype(np.int64))], ["hash", "times"]))
            at = np.flatnonzero(later)
            doc = np.searchsorted(starts, at, side="right") - 1
            _, at_first, times = np.unique((doc * len(h) + word[at]) * len(h) + before[at], return_index=True, return_counts=True)
            at, doc = at[at_first], doc[at_first]
            pair, absent = pair_hash(h[before[at]], h[word[at]]).view(np.int64), np.zeros(len(at), np.int64)
            code = times.astype(np.int64)
            for c in (c2[at], c1[at], ch[at]):
                code = code << 8 | np.where(c < 0, UNKNOWN, np.searchsorted(model.counts, c))
            values = [pair, np.where(c1[at] < 0, h[word[at]].view(np.int64), absent), np.where(ch[at] < 0, h[before[at]].view(np.int64), absent), code]
            open_tokens = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(doc, np.arange(len(bodies) + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(v) for v in values], ["pair", "word", "context", "code"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(bodies))), batch.column(0), batch.column(1), pa.array(lengths),
                 pa.array(known), pa.array(sure), pa.array(scores), tail, open_tokens],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "sure", "score", "tail", "open"])
            row += len(bodies)

    scored = saved(rows.mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, sure double, "
                                          "score double, tail array<struct<hash: long, times: long>>, "
                                          "open array<struct<pair: long, word: long, context: long, code: long>>"), "lm-scores")

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, c = np.frombuffer(h, "<u8"), np.frombuffer(c, "<u8")
                low = level_of(c.astype(float)) < head_level
                yield pa.RecordBatch.from_arrays([pa.array(h[low].view(np.int64)), pa.array(c[low].astype(np.int64))],
                                                 names=["hash", "n"])

    rare = counted.select("hashes1", "counts1").mapInArrow(rare_words, "hash long, n long")
    found = (scored.select("row", F.inline("tail")).join(rare, "hash")
             .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("found")))
    scored, score_sum = scored.drop("tail").join(found, "row", "left"), F.col("score")
    if max(model.lowest) > 1:
        rest = scores_by_join(scored, counted, model, strength)
        scored, score_sum = scored.join(rest, "row", "left"), F.col("score") + F.coalesce("late", F.lit(0.0))
    space = F.log10(F.lit(float(model.words + model.distinct + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(model.words).cast("long").alias("train_tokens"),
        (F.col("sure") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * space).alias("base_score"), score_sum.alias("score"))
