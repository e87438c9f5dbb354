"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all normalised items is walked word by word over a document; the longest suffix
that occurs in some item is tracked.  A window of an item ends at a word exactly where that length
reaches the window's.  Words of a document are first cut where two neighbours are never neighbours
in an item: no match crosses such a cut, and stretches shorter than the shortest window are skipped.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import broadcast, bytes_of, held, quoted, without

WINDOW = 10
# Words of items in one automaton.  More items are dealt over several automata, so that what is
# broadcast at a time stays small; each document passes them all in one task.
AUTOMATON_WORDS = 500_000

# A-Z to lower case; every ASCII byte that is no letter or digit parts words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with the windows of each item."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        sequences = [(item, [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]) for item, text in items]
        sequences = [(item, seq) for item, seq in sequences if seq]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        pairs = set()
        for _, seq in sequences:
            last = 0
            for w in seq:
                last = self._extend(last, w)
            pairs.update(zip(seq, seq[1:]))
        n = max(1, len(self.vocab))
        self.pairs = np.array(sorted(a * n + b for a, b in pairs), np.int64)
        self.shortest = min((min(window, len(s)) for _, s in sequences), default=0)
        # Items by the state of each of their windows (full windows, and whole short items).
        self.full: dict[int, set] = defaultdict(set)
        self.short: dict[int, list] = defaultdict(list)
        for item, seq in sequences:
            state = 0
            for i, w in enumerate(seq):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.full[self._cut(state, window)].add(item)
            if len(seq) < window:
                self.short[self._cut(state, len(seq))].append((len(seq), item))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _cut(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def stretches(self, words: list[bytes]) -> list[tuple[int, list[int]]]:
        """Where the document may hold a window: first word and ids of each stretch."""
        n, m = len(words), self.shortest
        if not m or n < m:
            return []
        get = self.vocab.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        known = ids >= 0
        linked = known[:-1] & known[1:]
        at = np.flatnonzero(linked)
        key = ids[at] * len(self.vocab) + ids[at + 1]
        place = np.searchsorted(self.pairs, key)
        linked[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == key if len(self.pairs) else False
        cuts = np.flatnonzero(~linked) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, n]
        keep = (ends - starts >= m) & known[starts]
        return [(int(a), ids[a:b].tolist()) for a, b in zip(starts[keep], ends[keep])]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [first, end) of the windows that occur, merged, and the items they are of."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        for first, ids in self.stretches(words):
            state = matched = 0
            for i, w in enumerate(ids, first):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if w not in self.next[state]:
                    continue
                state = self.next[state][w]
                matched += 1
                longest = 0
                if matched >= self.window:
                    at = self._cut(state, self.window)
                    longest = self.window
                    items |= self.full[at]
                if self.short:
                    at = state
                    while at > 0:
                        for length, item in self.short.get(at, ()):
                            if length <= matched:
                                items.add(item)
                                longest = max(longest, length)
                        at = self.link[at]
                if longest:
                    begin = i + 1 - longest
                    while spans and begin <= spans[-1][1]:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, items


def automata(items: DataFrame, item_id: str, text: str, window: int) -> list:
    """Broadcast automata over all items, each of a bounded number of words."""
    spark = items.sparkSession
    rows = items.select(quoted(item_id).cast("string").alias("item"), bytes_of(text).alias("body"))
    words = rows.select(F.sum(F.octet_length("body") / 2 + 1)).first()[0] or 0  # at least the words
    parts = int(words // AUTOMATON_WORDS) + 1
    out = []
    for k in range(parts):
        block = rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == k).collect()
        out.append(broadcast(spark, Automaton([(r.item, bytes(r.body)) for r in block], window)))
    return out


def _scan(built: list, body: bytes) -> tuple[int, list[tuple[int, int]], set]:
    words = words_of(body)
    spans: list[tuple[int, int]] = []
    items: set = set()
    for automaton in built:
        s, i = automaton.hits(words)
        spans += s
        items |= i
    if len(built) > 1:
        merged: list[tuple[int, int]] = []
        for a, e in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((a, e))
        spans = merged
    return len(words), spans, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_column: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document row; no shuffle.

    Null texts have no words; an item without words has no window; items that repeat an id count
    once; repeated rows are reported each; empty tables give an empty or an all-clean result.
    """
    sent = automata(benchmark, item_id, item_text, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [held(b) for b in sent]
        for batch in batches:
            found = [_scan(built, body) for body in batch.column(1).to_pylist()]
            digest = [hashlib.sha256(",".join(sorted(x for x in i if x is not None)).encode()).hexdigest() for _, _, i in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in found], pa.int64()),
                 pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64()),
                 pa.array([len(i) for _, _, i in found], pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = docs.select(quoted(id_column).cast("long").alias("doc_id"), bytes_of(text).alias("body"))
    found = rows.mapInArrow(work, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_words: int = WINDOW,
                         max_coverage: float = 0.5, text: str = "text", item_id: str = "item_id",
                         item_text: str = "text") -> DataFrame:
    """``docs`` with benchmark passages cut out, plus ``n_removed_words``; no shuffle.

    Spans of at least ``min_words`` hit words are removed (whole items shorter than a window
    always); a document of which more than ``max_coverage`` is hit goes altogether.  Clean rows
    pass unchanged, null texts too.  A column named ``n_removed_words`` is replaced.
    """
    sent = automata(benchmark, item_id, item_text, window)
    least = min(min_words, window)

    def cut(body: bytes, spans: list[tuple[int, int]]) -> bytes:
        normal = np.frombuffer(body.translate(NORMAL), np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.r_[False, normal, False].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        out, at = [], 0
        for a, b in spans:
            out.append(body[at:starts[a]])
            at = int(ends[b - 1])
        return b"".join(out) + body[at:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = [held(b) for b in sent]
        for batch in batches:
            bodies, removed = batch.column(1).to_pylist(), []
            for k, body in enumerate(bodies):
                n, spans, _ = _scan(built, body or b"")
                spans = [(a, b) for a, b in spans if b - a >= least or b - a < window]
                hit = sum(b - a for a, b in spans)
                removed.append(-1 if hit > max_coverage * n else hit)
                if hit and removed[-1] > 0:
                    bodies[k] = cut(body, spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.binary()),
                                              pa.array(removed, pa.int64())], names=["row", "body", "removed"])

    rest = without(docs, ["n_removed_words", text])
    rows = without(docs, ["n_removed_words"]).select(
        F.struct(*[quoted(c) for c in rest.columns]).alias("row"), quoted(text).cast("string").cast("binary").alias("body"))
    done = rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, body binary, removed long")
    kept = done.where("removed >= 0").select("row.*", F.decode("body", "UTF-8").alias(text),
                                             F.col("removed").alias("n_removed_words"))
    names = [c for c in docs.columns if c.lower() != "n_removed_words"]
    return kept.select(*[quoted(c) for c in names], "n_removed_words")
