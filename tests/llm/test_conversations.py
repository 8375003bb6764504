import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagewright.llm import conversation_trie as ct

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    import base64

    return base64.b64encode(hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16])


def expected(rows, rebuilt=True):
    """The contract, conversation by conversation and node by node."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    saved, leaves, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, rebuilt=True):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("c", "part", "key", "pos", "s", "rep", "block", "v")})
    return sorted((tuple(r[c] for c in COLUMNS) for r in ct.conversation_trie(df, rebuilt).collect()), key=repr)


def made(seed, n, longest, words=3, roles=("user", None)):
    """Conversations that share openings, with copies."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(r.randint(1, longest)):
            rows.append((c * r.choice([1, 1, 7]), turn, r.choice(roles), "x" * r.randrange(words)))
    return rows


@pytest.fixture
def small(monkeypatch):
    """Blocks, chunks and spans so small that every way across them is taken."""
    for name, value in (("BLOCK", 3), ("CHUNK", 2), ("SPAN", 2), ("PIECE", 2)):
        monkeypatch.setattr(ct, name, value)
    monkeypatch.setattr(ct.math, "isqrt", lambda n: 3)


def test_equals_brute_force_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert run(spark, rows) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_across_blocks_and_chunks(spark, small, seed):
    rows = made(seed, 40, 12, words=2)
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, False) == expected(rows, False)


def test_one_chain_many_copies_and_a_long_conversation(spark, small):
    rows = [(c, t, "user", "a") for c in range(30) for t in range(c % 7)] + [(99, t, "user", "a") for t in range(300)]
    rows += [(c, 0, "user", "b") for c in range(200, 260)]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, False) == expected(rows, False)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (0, None, None, None), (0, None, None, None), (0, 1, "user", "é漢😀"), (1, 0, "user", ""), (1, 0, "assistant", ""), (1, 0, "user", "tie"),
        (-3, 5, "user", "x" * 50000), (-3, -2**40, "user", "x"), (7, 1, "u", "ser1:"), (8, 1, "us", "er1:"), (2**62, 0, "user", "x"), (11, 0, "user", "x"), (16, 0, "user", "x"),
    ]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, False) == expected(rows, False)
    assert run(spark, rows[:1]) == []
    assert run(spark, [(5, 0, "user", "alone")]) == expected([(5, 0, "user", "alone")])
