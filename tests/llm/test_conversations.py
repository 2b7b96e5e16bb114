"""The prefix trie of conversations against a plain one, on the table, odd rows, long and hot conversations."""

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from voltlane.llm import trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
CLASHES = ("place", "name", "tokens", "base", "own", "n", "piece", "depth", "node", "member", "weight", "range", "shared", "head")


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    base = lambda c: int(c / 100) * 100
    return {c: turns.get(base(c), [])[: heads[c]] + ts[heads[c] :] for c, ts in turns.items()}


def plain_trie(rows):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(rebuilt(rows).items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in sorted(members, key=len, reverse=True):
        if key:
            children[key[:-1]] += 1
            saved[key] += (len(members[key]) - 1) * len(key[-1][1])
        leaves[key] += not children[key]
        if key:
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    hashed = lambda ids: sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], hashed(ends[k])) for k, m in members.items()
    )


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in CLASHES]).repartition(3)
    got = trie.prefix_trie(frame)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]
    assert sorted(tuple(r) for r in got.fillna(-1, ["parent_conv_id"]).collect()) == plain_trie(rows)


def test_table(spark):
    check(spark, duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall())


def test_odd_long_and_hot(spark):
    rows = [(None, 0, "user", "no conversation"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"), (0, 0, "user", ""), (0, 0, "user", "")]
    rows += [(1, 0, "", "user"), (1, 1, "u", "ser"), (2, 0, "u", "ser"), (205, 7, "user", "alone"), (205, 3, "😀", "é" * 5000), (-7, 0, "user", "x"), (301, 0, "a", None)]
    rows += [(c, t, "user", f"turn {t}") for c in (400, 403) for t in range(70)]
    rows += [(c, t, "user", f"turn {t % 3}") for c in range(500, 580) for t in range(4)] + [(c, 0, "user", "hello") for c in range(580, 660)]
    check(spark, rows)


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
