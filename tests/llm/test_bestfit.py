"""Bounded-space best-fit packing against a plain list of bins."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bestfit
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_best_fit(sizes, length, most):
    """(bin, offset) of each size: a list of [left, last used, bin] instead of a bitset."""
    open_bins, out, bins = [], [], 0
    for now, size in enumerate(sizes):
        fitting = [b for b in open_bins if b[0] >= size]
        if fitting:
            best = min(fitting, key=lambda b: (b[0], -b[1]))
        else:
            best = [length, now, bins]
            bins += 1
            if size < length:
                if len(open_bins) == most:
                    open_bins.remove(min(open_bins, key=lambda b: (b[0], -b[1])))
                open_bins.append(best)
        out.append((best[2], length - best[0]))
        best[0] -= size
        best[1] = now
        if best in open_bins and not best[0]:
            open_bins.remove(best)
    return out


@pytest.mark.parametrize("most", [1, 2, 7, 100])
def test_bitset_equals_a_list_of_bins(most):
    for seed in range(20):
        rng = random.Random(seed)
        length = rng.choice([3, 10, 64, 1024])
        sizes = [rng.randint(1, length) if seed % 2 else min(length, 1 + int(rng.expovariate(4 / length))) for _ in range(400)]
        bins = bestfit.OpenBins(length, most)
        assert [bins.place(s) for s in sizes] == plain_best_fit(sizes, length, most)
        assert bins.count <= most and bins.count == sum(map(len, bins.by_space.values()))


def test_fullest_closes_first():
    bins = bestfit.OpenBins(10, 2)
    assert [bins.place(s) for s in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]
    assert [bins.place(s) for s in (3, 1, 1)] == [(0, 6), (0, 9), (2, 9)]  # bin 1, the fullest then, is closed


def test_cuts_leave_only_the_first_piece_short():
    assert bestfit.cut(0, 4) == [] and bestfit.cut(3, 4) == [(0, 3)] and bestfit.cut(4, 4) == [(0, 4)]
    assert bestfit.cut(9, 4) == [(0, 1), (1, 4), (5, 4)] and bestfit.cut(8, 4) == [(0, 4), (4, 4)]


def checked(rows, ids_of, length):
    """The contract on collected pieces; returns the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids_of.keys()
    for doc, own in pieces.items():
        ids, at = ids_of[doc], 0
        for k, r in enumerate(sorted(own, key=lambda r: r.start)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at:at + r.length], "<u4").tobytes())
            assert r.length == length or k == 0
            at += r.length
        assert at == len(ids) and (len(own) == 1 or len(ids) > length)
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences)


def test_query_by_brute_force(spark):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    ids_of = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
              for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    used = checked(rows, ids_of, 1024)
    assert used <= 1.02 * -(-sum(map(len, ids_of.values())) // 1024) + 1


def test_padding_stays_low_whatever_the_order(spark):
    """Short, equal and growing lengths in one task: at most one sequence in a hundred and two more than need be."""
    for words in ([1] * 3000, list(range(1, 300)) * 4, [411] * 500 + [99] * 500):
        df = spark.createDataFrame([(i, "a " * (n - 1) + "a") for i, n in enumerate(words)], "doc_id long, text string").coalesce(1)
        got = bestfit.pack_best_fit(df, BYTE_BPE).collect()
        assert len({r.sequence_id for r in got}) <= 1.01 * sum(r.length for r in got) / 1024 + 2


def test_awkward_rows(spark, awkward):
    got = bestfit.pack_best_fit(awkward, BYTE_BPE).collect()
    assert sum(r.piece == 0 for r in got) == awkward.count()
    empty = [r for r in got if r.doc_id in (2, 3)]
    assert [(r.start, r.length, bytes(r.ids)) for r in empty] == [(0, 1, b"\x02\0\0\0")] * 2
    assert bestfit.pack_best_fit(awkward.where("doc_id < -1"), BYTE_BPE).collect() == []
