"""The conversation trie against plain Python and the SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import oracle, prefix_trie, registry
from phenoframe.llm.stages import Scratch

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, s string, depth long, hi string, N_convs string, x string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 3, "b", "c", "d") for r in rows], SCHEMA)


def brute(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            said.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    members, ends = {}, {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = tuple(said.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(full) + 1):
            members.setdefault(full[:d], []).append(c)
        ends.setdefault(full, []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[b] for b in below) or 1
        saved[k] = sum(saved[b] for b in below) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    return [(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children.get(k, [])), leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items()]


def conversations(seed, n, most, words):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"][: 1 + (t > 2)]), rng.choice(words)) for c in range(n) for t in range(rng.randint(1, most))]


CASES = {
    "empty table": [],
    "no ids": [(None, 1, "user", "a")],
    "one": [(3, 0, "user", "Hi é")],
    "nulls and ties": [(0, None, None, None), (0, 1, "user", "a"), (1, 1, "user", ""), (1, None, "", None), (2, 5, "user", "x" * 200_000), (10, 1, "user", "a"), (15, 2, "user", "a"),
                       (20, 1, "user", "a"), (20, 1, "user", "a"), (None, 1, "user", "z")],
    "few words": conversations(1, 150, 6, ["a", "b"]),
    "one word": conversations(2, 60, 12, ["a"]),
    "long": conversations(3, 12, 300, ["a"]) + [(100 + c, t, "user", "a" if t < 40 * c else f"{c}") for c in range(6) for t in range(250)],
    "copies": [(c, t, "user", f"{t}") for c in range(200) for t in range(5)],
    "turnless": [(c, 0, "user", "a") for c in range(1, 40)],
}


@pytest.mark.parametrize("name", CASES)
def test_brute_force(spark, name):
    got = prefix_trie.conversation_trie(table(spark, CASES[name]).repartition(3))
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, brute(CASES[name])))


def test_batches_make_the_same_trie(spark, monkeypatch):
    """Nodes do not depend on the batches; names and handles are those of their edges."""
    rng = random.Random(5)
    strings = sorted({tuple(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(120)})
    rows = [(s, d + 1, hash(string[:d + 1]), d, hash(string[:d]), d - 1, len(string)) for s, string in enumerate(strings) for d in range(len(string))]
    prefixes = spark.createDataFrame(rows, "s long, depth long, x long, y long, px long, py long, len long")
    every = prefixes.select("s", "len").distinct()
    prefix = {(s, d): x for s, d, x, *_ in rows} | {(s, 0): hash(()) for s in range(len(strings))}
    ends, ways = set(strings), {}
    for string in strings:
        for d in range(len(string)):
            ways.setdefault(string[:d], set()).add(string[d])
    want = {hash(k) for k in [s[:d] for s in strings for d in range(1, len(s) + 1)] if k in ends or len(ways.get(k, ())) > 1}
    for batches in ((16,), (1, 4, 16), (2, 4, 6, 8, 10, 12, 14, 16)):
        monkeypatch.setattr(prefix_trie, "BATCHES", batches)
        scratch = Scratch(prefixes)
        got = prefix_trie.trie(prefixes, every, 14, scratch).collect()
        scratch.remove()
        assert sorted(r.x for r in got) == sorted(want)
        for r in got:
            assert prefix[r.s, r.hi] == r.x and prefix[r.s, r.lo] == r.px and prefix[r.s, r.lo + 1] == r.nx and prefix[r.s, r.f] == r.fx
            assert r.lo == 0 or r.px in want
            assert r.f == max(range(r.lo + 1, r.hi + 1), key=lambda f: f & -f)


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 40)] + [(2**40, 2**40 + 3), (5, 2**50 + 1)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert f == b & ~((1 << ((a ^ b).bit_length() - 1)) - 1) and a < f <= b


def test_many_ids_end_in_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    ends = spark.createDataFrame([(c, 1 + c % 2, 5, 6) for c in range(100)], "conv long, hi long, x long, y long")
    got = {r.hi: r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    assert got == {h: hashlib.sha256(",".join(str(c) for c in range(100) if 1 + c % 2 == h).encode()).hexdigest() for h in (1, 2)}


def test_sql(spark):
    got = registry.queries()["op12_conversation_trie"](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    want = con.execute(oracle.oracle_sql()["op12_conversation_trie"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want) and len(got) > 50
