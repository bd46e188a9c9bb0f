"""op12: the z-fast trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from banditflow.llm import conversation_trie as C

SCHEMA = "conv_id long, turn long, role string, text string"


def dictionary(rebuilt):
    """The rows of prefix_nodes for {conversation: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(spark, rebuilt, partitions=4):
    rows = [(c, d, r, t) for c, turns in rebuilt.items() for d, (r, t) in enumerate(turns)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    steps = C.ordered_turns(df).withColumnRenamed("pos", "d")
    ids = spark.createDataFrame([(c,) for c in rebuilt], "conv long")
    return sorted((tuple(r) for r in C.prefix_nodes(steps, ids).collect()), key=str)


def bushy(n, seed):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        out[3 * c - 40] = [(rng.choice("ua"), rng.choice(["", "x", "yé🙂"])) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))]
    return out


@pytest.mark.parametrize("rebuilt", [
    bushy(120, 1),
    {c: [("user", "same")] * 5 for c in range(60)},  # copies
    {c: [("user", "a")] * c for c in range(40)},  # each is a prefix of the next
    {c: [("user", "a")] * c + [("user", "b")] * (40 - c) for c in range(40)},  # a comb
    {1: [("user", f"{i}") for i in range(700)], 2: [("user", f"{i}") for i in range(650)] + [("user", "other")], 5: []},
    {9: []},
], ids=["bushy", "copies", "prefixes", "comb", "long", "turnless"])
def test_nodes_equal_the_dictionary(spark, rebuilt):
    assert nodes_of(spark, rebuilt) == dictionary(rebuilt)


def test_empty_tables_have_no_node(spark):
    assert nodes_of(spark, {}) == []


def test_edges_longer_than_a_spread_and_prefixes_over_partitions(spark):
    spread, C.SPREAD = C.SPREAD, 16
    try:
        rebuilt = {c: [("user", f"{min(i, 90 + c)}") for i in range(120)] for c in range(3)}
        assert nodes_of(spark, rebuilt, 7) == dictionary(rebuilt)
    finally:
        C.SPREAD = spread


def test_two_fattest_handles(spark):
    rows = spark.range(0, 40).selectExpr("id as low").crossJoin(spark.range(0, 41).selectExpr("id as high"))
    for r in rows.select("low", "high", C._fattest("low", "high").alias("f")).collect():
        if r.low >= r.high:
            assert r.f is None
        else:
            assert r.f == max(range(r.low + 1, r.high + 1), key=lambda x: (x & -x, x))


def test_rebuilt_conversations_with_nulls_ties_repeats_and_other_columns(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), -100, -98, -3, None]:
        for t in range(rng.choice([1, 2, 4, 7])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, ""])))
    rows += rows[5:9]  # repeated rows
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("d", F.lit(1)).withColumn("_turn", F.lit(2))
    turns = C.ordered_turns(df)
    order = {(r.conv, r.pos): (r.ta, r.tb) for r in turns.collect()}
    assert sorted(c for c, _ in order) == sorted(r[0] for r in rows if r[0] is not None)
    words = {}
    for role in ("user", "assistant", ""):
        for text in ("a", "b", ""):
            one = spark.range(1).select(F.xxhash64(F.lit(role), F.lit(text)).alias("a")).first()
            words[one.a] = (role, text)
    given = defaultdict(list)
    for c, pos in sorted(order):
        given[c].append(words[order[c, pos][0]])
    for c, turns_of in given.items():  # turns by number, null first, as multisets of each number
        mine = defaultdict(list)
        for r in rows:
            if r[0] == c:
                mine[(r[1] is not None, r[1] or 0)].append((r[2] or "", r[3] or ""))
        at = 0
        for key in sorted(mine):
            assert sorted(turns_of[at : at + len(mine[key])]) == sorted(mine[key])
            at += len(mine[key])
    rebuilt = {}
    for c in given:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = given.get(c - c % 100, [])[:h] + given[c][h:]
    got = C.prefix_nodes(C.with_shared_openings(turns), turns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == dictionary(rebuilt)
