"""MinHash components against brute force and the SQL; the posterior bound against its integral."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import bayes_minhash, oracle, registry
from phenoframe.llm.stages import Scratch

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n string, node string, Label string, key string, row long, kept string, component_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 5, "e", "f") for r in rows], SCHEMA)


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return set(zip(words, words[1:])) if len(words) != 1 else {tuple(words)}


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[top(i)] = top(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None] if sets[i] else [d]
        least = min(ids) if ids and ids[0] is not None else None
        out.append((d, len(sets[i]), least, d == least))
    return out


def edited(rng, words, share):
    return [rng.choice("pqrstuv") + w if rng.random() < share else w for w in words]


def corpus(seed):
    """Families of near copies on both sides of the threshold, chains, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.8)) % 3000}"
    rows = [[word() for _ in range(rng.randint(1, 250))] for _ in range(120)]
    for head in rows[:25]:
        rows += [edited(rng, head, rng.choice([0, 0.01, 0.05, 0.08, 0.1, 0.12])) for _ in range(rng.randint(1, 9))]
    big = [word() for _ in range(150)]
    rows += [edited(rng, big, rng.choice([0.02, 0.055])) for _ in range(150)]
    chain = big[:80]
    for _ in range(25):
        chain = edited(rng, chain, 0.03)
        rows.append(chain)
    rng.shuffle(rows)
    return [(3 * i + 1, " ".join(r).title() if i % 4 == 0 else "\n".join(r)) for i, r in enumerate(rows)]


CASES = {
    "empty table": [],
    "blank": [(1, None), (2, ""), (3, " \t\x0b"), (None, None)],
    "few words": [(1, "one"), (2, "ONE"), (3, "one two"), (4, "two one"), (5, "One\ttwo"), (None, "one two"), (6, "one one one"), (7, "é"), (8, "É")],
    "no ids": [(None, "one two three"), (None, "One two three")],
    "ties and repeats": [(4, "a b c")] * 3 + [(2, "a b c a b c")] * 2 + [(9, "x " * 100_000), (8, "x x")],
    "copies": [(i, "the same old text") for i in range(400)] + [(1000, "another text")],
    "one long text": [(1, " ".join(f"w{i}" for i in range(200_000))), (2, " ".join(f"w{i}" for i in range(190_000)))],
}


@pytest.mark.parametrize("name", CASES)
def test_edges(spark, name):
    got = bayes_minhash.near_duplicates(table(spark, CASES[name]).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = [(d, n, c, k or d is c) for d, n, c, k in brute(CASES[name])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(map(tuple, bayes_minhash.near_duplicates(table(spark, rows)).collect()))
    want = sorted(brute(rows))
    assert got == want
    sizes = np.unique([c for _, _, c, _ in want], return_counts=True)[1]
    assert sizes.max() > 50 and (sizes == 1).sum() > 50


def test_opened_buckets_find_all_links_without_stars(spark, monkeypatch):
    """The exact way for what the rounds leave: every pair of a bucket that links and differs in component."""
    monkeypatch.setattr(bayes_minhash, "CHUNK", 10)
    monkeypatch.setattr(bayes_minhash, "QUERIES", 4)
    monkeypatch.setattr(bayes_minhash, "OPEN_CHUNK", 6)
    monkeypatch.setattr(bayes_minhash, "OPEN_QUERIES", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(edited(rng, base, 0.03)) for _ in range(60)]
    value, edges = bayes_minhash.shingles(texts)
    signed = bayes_minhash.signatures(value, edges[:-1])
    nodes = spark.createDataFrame([(i, int(n), row.tobytes()) for i, (n, row) in enumerate(zip(np.diff(edges), signed))], "node long, n long, signature binary")
    keys = nodes.mapInArrow(bayes_minhash.band_keys, "key long, node long").withColumn("label", F.when(F.col("node") > 20, F.col("node")).otherwise(0))
    rows = bayes_minhash.differing(keys, 60 * bayes_minhash.BANDS).select("key", "node", "label")
    sets = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(1, 21)] + [(0, 0)], "node long, label long")
    scratch = Scratch(nodes)
    near = bayes_minhash.others(rows, nodes, scratch)
    found = {tuple(sorted((r.a, r.b))) for r in bayes_minhash.opened(near, nodes, labels, sets, scratch).collect()}
    scratch.remove()
    label = [0 if i <= 20 else i for i in range(60)]
    got = {tuple(sorted((label[a], label[b]))) for a, b in found}
    want = set()
    for a in range(60):
        for b in range(a + 1, 60):
            one, other = set(value[edges[a]:edges[a + 1]]), set(value[edges[b]:edges[b + 1]])
            if label[a] != label[b] and 100 * len(one & other) >= 80 * len(one | other):
                want.add((label[a], label[b]))
    assert got == want and len(want) > 100


def test_posterior_bound():
    s = (np.arange(200_000) + 0.5) / 200_000
    for i, least in enumerate(bayes_minhash.least_matches()):
        n = (i + 1) * bayes_minhash.BATCH
        for m, stays in ((least, True), (least - 1, False)):
            if m >= 0:
                density = m * np.log(s) + (n - m) * np.log1p(-s)
                density = np.exp(density - density.max())
                assert (density[s >= 0.8].sum() / density.sum() >= bayes_minhash.MISS) == stays


def test_signatures_estimate_similarity():
    rng = random.Random(6)
    for share in (0.05, 0.2, 0.5):
        errors = []
        for k in range(30):
            base = [f"v{k}x{i}" for i in range(300)]
            value, edges = bayes_minhash.shingles([" ".join(base), " ".join(edited(rng, base, share))])
            one, other = (set(value[edges[i]:edges[i + 1]].tolist()) for i in (0, 1))
            signed = bayes_minhash.signatures(value, edges[:-1])
            errors.append((signed[0] == signed[1]).mean() - len(one & other) / len(one | other))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_sql(spark):
    got = registry.queries()["op11_bayes_minhash"](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(oracle.oracle_sql()["op11_bayes_minhash"]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want) and (got.kept == "False").any()
