"""Hard negatives against all scores computed one by one."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label long, embedding array<double>, note string"


def brute(rows, positives=5, most=10):
    """rows: (id, label, vector); the defined result with row order as the last tie-break left out."""
    sound = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows
             if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (anchor, label, q) in enumerate(sound):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i is None, i or 0, k) for k, (i, _, v) in enumerate(sound) if k != n))
        near = [s for s in scored if sound[s[3]][1] == label][:positives]
        for score, null, i, _ in near:
            inside = [s for s in scored if sound[s[3]][1] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:most]
            out += [(anchor, None if null else i, rank, None if s[1] else s[2], -score, -s[0]) for rank, s in enumerate(inside, 1)]
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return negatives.hard_negatives(df, F.expr("vec_id % 100 = 0"), **options)


def same(got, rows, **options):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, **options), key=key)


def clustered(n, dims=8, centres=6, spread=0.3, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    v = middle[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return [(10 * i, int(rng.integers(0, 4)), [float(x) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize("block,group", [(4096, 256), (37, 5), (1, 1)])
def test_against_brute_force(spark, block, group):
    rows = clustered(150 if block == 1 else 600)
    same(mined(spark, rows, block=block, group=group), rows)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(QUERIES["op13_hard_negatives"](spark, SF), rows)


def test_awkward_rows(spark):
    rng = random.Random(1)
    v = lambda n=4: [rng.uniform(-1, 1) for _ in range(n)]
    alike = v()
    rows = [(i, i % 3, v()) for i in range(0, 400, 4)]
    rows += [(500 + i, i % 2, alike) for i in range(40)]  # a group of copies, ties everywhere
    rows += [(600, 1, alike), (600, 2, v()), (None, 1, v()), (None, 2, alike), (700, None, v()), (800, 1, None), (900, 2, [1.0, None]),
             (1000, 0, [float("nan")] * 4), (1100, 0, [float("inf"), 0.0]), (1200, 1, []), (1300, 2, v(2)), (1400, 0, v(9)), (-100, 1, v())]
    same(mined(spark, rows, block=16, group=4), rows)
    assert mined(spark, []).collect() == []


def test_components_beyond_what_doubles_add_up(spark):
    rng = random.Random(2)
    rows = [(50 * i, i % 2, [rng.uniform(-1, 1) * 2.0 ** rng.choice([3, 21]) for _ in range(3)]) for i in range(60)]
    same(mined(spark, rows, block=16, group=4), rows)


def test_bounds_spare_rescoring():
    """Near anchors: most rows outside the windows are not scored again."""
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(32)
    anchors = np.floor(256 * (centre + 0.01 * rng.standard_normal((50, 32))))
    matrix = np.floor(256 * rng.standard_normal((2000, 32)))
    order, parents, edges = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(50)) and all(parents[k] < k for k in range(1, 50))

    def made(m, label):
        row = dict(zip(("block", "n", "dims", "numbers", "ids", "labels", "matrix", "kind"),
                       negatives.packed(0, list(range(len(m))), np.full(len(m), label), m, np.arange(len(m)) + 10_000 * label)))
        return negatives.Block(row)

    bounds = negatives.Bounds(made(matrix, 1), made(anchors[order], 0), parents, edges)
    best = int((matrix @ anchors[0]).max())
    found = list(negatives.find_negatives(bounds, [[(1, *negatives.windows_of(best, 80, 100))]] * 50, 10))
    assert bounds.scored < 2000 * 50 / 4
    least, greatest = negatives.windows_of(best, 80, 100)
    expected = defaultdict(list)
    for k, a in enumerate(anchors[order]):
        s = matrix @ a
        rows = [i for i in np.lexsort((np.arange(2000), -s)) if least <= s[i] <= greatest][:10]
        expected[k] = rows
    got = defaultdict(list)
    for number, _, _, i, _ in found:
        got[number].append(i)
    assert got == {k: v for k, v in expected.items() if v}
