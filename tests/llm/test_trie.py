"""The prefix trie against a plain one built in memory."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import trie
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, node int"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = sum(saved[x] for x in children[p]) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got_of(df):
    assert tuple(df.columns) == NAMES
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def built(spark, rows, shards=None):
    return trie.prefix_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), shards)


def conversations(n, seed, most=12, alphabet=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), "wé" * rng.randint(0, alphabet)) for c in range(-10, n - 10) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("shards", [1, 2, 7, 40, 1000])
def test_against_a_plain_trie(spark, shards):
    rows = conversations(120, shards)
    assert got_of(built(spark, rows, shards)) == brute(rows)


@pytest.mark.parametrize("shards", [3, 50])
def test_most_conversations_alike(spark, shards, monkeypatch):
    """Copies part between shards; the list of those that end in one node passes in pieces."""
    monkeypatch.setattr(trie, "ENDS", 64)
    same = [("user", "a"), ("assistant", "bb"), ("user", ""), ("assistant", "c" * 50)] * 4
    rows = [(c, t, role, text) for c in range(300) for t, (role, text) in enumerate(same)] + conversations(60, 9)
    rows = [r if r[0] < 0 or i < 4800 else (r[0] + 1000, *r[1:]) for i, r in enumerate(rows)]
    assert got_of(built(spark, rows, shards)) == brute(rows)


def test_query_against_a_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got_of(QUERIES["op12_prefix_trie"](spark, SF)) == brute(rows)


def test_awkward_rows(spark):
    rows = conversations(30, 4)
    rows += [(5, None, None, None), (5, None, "user", None), (None, 1, "user", "lost"), (7, 0, "user", "twice"), (7, 0, "user", "twice"),
             (2 ** 62, 0, "a", "x" * 100_000), (-(2 ** 62), 3, "", ""), (8, 0, "us", "er"), (8, 0, "user", "")]
    rows += [(5000, t, "user", f"long {t}") for t in range(3000)] + [(5001, 0, "user", "short")]  # copies its first turns
    assert got_of(built(spark, rows, 10)) == brute(rows)
    assert got_of(built(spark, [], 10)) == []
    assert got_of(built(spark, [(1, 0, "user", "a")], 10)) == brute([(1, 0, "user", "a")])


def test_splitters_cut_a_group_of_copies():
    path = b"p" * 48
    skeleton = trie.Skeleton([(b"a" * 16, 3), (path, 10), (path, 20)])
    assert [skeleton.shard(path, c) for c in (9, 10, 19, 20)] == [1, 2, 2, 3]
    assert skeleton.nodes[1] == skeleton.nodes[2] and len(skeleton.parents) == 5  # root, a, p, pp, ppp
    assert skeleton.along(2, path) == skeleton.nodes[1]
    assert skeleton.along(1, b"a" * 32) == skeleton.nodes[0]
    assert skeleton.along(3, b"z" * 16) == [0]
