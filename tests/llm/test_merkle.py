"""The manifest against plain Python and the SQL; running totals over large groups."""

import hashlib
import random
import zlib

import duckdb
import pytest

from phenoframe.llm import merkle, oracle, registry
from phenoframe.llm.running import join_hot, running
from phenoframe.llm.stages import Scratch

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string, run_place string, place long, Root string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(digests):
    """Root, and for each node its siblings before and after it, level by level."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            paths[i].append((run[:a % 8], run[a % 8 + 1:]))
            at[i] = a // 8
        level = [sha("".join(level[j:j + 8])) for j in range(0, len(level), 8)]
    return level[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        text = r[4]
        if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        trees.setdefault(r[2], []).append((r[0], leaf(r, r[4]), leaf(r, text)))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        built[lang] = climb([x[1] for x in trees[lang]])
    root, above = climb([built[x][0] for x in langs])
    out = []
    for lang, top in zip(langs, above):
        for (doc, own, told), path in zip(trees[lang], built[lang][1]):
            for before, after in path + top:
                told = sha("".join(before) + told + "".join(after))
            out.append((doc, own, built[lang][0], root, sha("".join(x for s in path + top for y in s for x in y)), told, told == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 7, "w") for r in rows], SCHEMA)


CASES = {
    "empty table": [],
    "one row": [(5, "s", "en", 3, "One")],
    "nulls and ties": [(None, None, None, None, None), (None, "s", None, 1, "A"), (1, "s", "en", 2, ""), (1, "s", "en", 2, ""), (1, "s", "en", 2, "B"),
                       (2, "s", "", 2, "C:1"), (3, None, "-", 2, "É" * 5), (4, "s", "=", 9, "Long Word " * 30_000)],
    "deep and wide": [(i * 7 % 1000 - 3, "s", "en" if i % 10 else f"l{i % 13}", i, f"Text {i}") for i in range(700)],
    "sixty-four": [(i, "s", "en", i, f"T{i}") for i in range(64)] + [(i, "s", "fr", i, f"T{i}") for i in range(65)],
    "many languages": [(i, "s", f"lang{i}", i, f"T{i}") for i in range(100)],
    "copies": [(1, "s", "en", 2, "Same")] * 200 + [(i, "s", "en", 2, "Same") for i in range(50)],
}


@pytest.mark.parametrize("name", CASES)
def test_brute_force(spark, name):
    got = merkle.manifest(table(spark, CASES[name]).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(CASES[name]) if CASES[name] else []
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))


def test_row_limit_is_put_back(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        assert merkle.manifest(table(spark, CASES["sixty-four"])).where("verified").count() > 5
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "5"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_sql(spark):
    got = registry.queries()["op13_merkle_manifest"](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(oracle.oracle_sql()["op13_merkle_manifest"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want) and 0 < (got.verified == "False").sum() < len(got)


def test_running(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "b", "b", "c"]), rng.randint(-9, 9), rng.randint(-100, 100), rng.randint(-2**62, 2**62)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, s long, x long").repartition(6)
    scratch = Scratch(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(scratch.keep(df, "rows"), "g", ["o", "s", "x"], scratch, ["s"], ["x"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        scratch.remove()
    want = []
    for g in (None, "a", "b", "c"):
        total = mixed = 0
        for i, (_, o, s, x) in enumerate(sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])):
            total, mixed = total + s, mixed ^ x
            want.append((g, o, s, x, i, total, mixed))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_join_hot(spark):
    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(2000)], "k long, v long")
    facts = rows.groupBy("k").count()
    got = join_hot(rows, facts, ["k"], "count", 2000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(facts, "k").collect())) and len(got) == 2000
