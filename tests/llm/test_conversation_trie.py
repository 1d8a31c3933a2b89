"""The conversation trie against a dictionary of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from calibrant.llm import conversation_trie as ct

TURNS = "conv_id bigint, turn bigint, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {conv: [t[2:] for t in sorted(listed)] for conv, listed in own.items()}
    rebuilt = {}
    for conv, listed in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        rebuilt[conv] = turns.get(base, [])[:h] + listed[h:]
    members = defaultdict(list)
    for conv, listed in rebuilt.items():
        for d in range(len(listed) + 1):
            members[tuple(listed[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        saved[node] = sum(saved[c] for c in below) + (
            (len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **rules):
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("depth"), F.lit("x").alias("part"))
    return cases.table(ct.trie_table(df, ct.Rules(**rules)).select(*NAMES))


def made(seed, n_convs, n_texts, longest):
    draw = random.Random(seed)
    rows = []
    for conv in draw.sample(range(-250, 650), n_convs):
        for turn in range(draw.randint(1, longest)):
            rows.append((conv, turn, draw.choice(["user", "assistant"]), draw.choice("abcdefgh"[:n_texts]) * 3))
    return rows


ODD = [
    (None, 0, "user", "no conversation"), (0, None, "user", "null first"), (0, 0, None, None), (0, 1, "", ""),
    (0, 2, "user", "ü😀"), (1, 0, "user", "null first"), (1, 0, "user", "null first"), (2, 5, "b", "tie"),
    (2, 5, "a", "tie"), (2, 6, "a", cases.LONG), (205, 1, "a", "its base is absent"), (777, 1, None, "one"),
    (-5, 0, "user", "below zero"), (-105, 3, "user", "x"), (103, 0, "user", "y"), (100, 0, "user", "null first"),
]


@pytest.mark.parametrize("whole", [8192, 1])
def test_odd_rows(spark, whole):
    assert got(spark, ODD, whole=whole) == expected(ODD)


@pytest.mark.parametrize("seed, n_convs, n_texts, longest, whole", [
    (1, 300, 2, 9, 8192), (2, 200, 1, 30, 40), (3, 150, 3, 12, 7)])
def test_made_conversations(spark, seed, n_convs, n_texts, longest, whole):
    rows = made(seed, n_convs, n_texts, longest)
    assert got(spark, rows, whole=whole) == expected(rows)


def test_one_long_conversation(spark):
    rows = [(0, i, "user", f"turn {i % 50}") for i in range(1500)] + [
        (c, i, "user", f"turn {i % 50}") for c in range(1, 30) for i in range(6 + c)]
    assert got(spark, rows, whole=200) == expected(rows)


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []


def test_rounds_grow_with_the_logarithm(spark):
    """A path of n nodes is no n rounds: every part has at most half of the mass."""
    n = 6000
    conv, depth = np.zeros(n, np.int64), np.arange(n)
    result = ct.decompose(np.zeros(n, np.int64), conv, depth, conv, np.arange(n, 0, -1),
                          np.ones((n, 2), np.int64), np.zeros((n, 2), np.int64))
    assert (result[:, 0] == np.arange(n, 0, -1)).all()


def test_a_conversation_is_split_over_parts(spark):
    rows = [(7, i, "user", f"turn {i}") for i in range(4000)]
    ranked = ct.number_turns(spark.createDataFrame(rows, TURNS))
    assert ranked.select("part").distinct().count() == 4
    assert sorted(row.rank for row in ranked.collect()) == list(range(1, 4001))
