"""Quality rules, sharding, fingerprints and mixing against plain Python and the SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from phenoframe.llm import fingerprints, mixing, oracle, quality, registry, sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, words string, lines string, kept string, topic string"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "r", "w", "l", "k", None) for d, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "one."), (4, "one."), (None, "two three."), (5, "a b c a b c a b c"), (6, "x " * 30_000)]


def same_as_sql(spark, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(oracle.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    got, want = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert got.equals(want)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op5_sharding", "op8_source_mixing"])
def test_sql(spark, name):
    same_as_sql(spark, name)


def repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i:i + 3]), []).append(i)
    return len({i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)})


def test_counts_brute_force(spark):
    rng = random.Random(2)
    rows = EDGES + [(10 + i, "".join(rng.choice(["a", "b", "c#", " ", " ", "\n", "\x0b", "é", "|"]) for _ in range(rng.randint(0, 400)))) for i in range(60)]
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                 for r in quality.quality_report(table(spark, rows)).collect())
    want = []
    for d, t in rows:
        t = t or ""
        w = t.encode().split()
        lines = [x for x in t.split("\n") if x.encode().split()]
        n = repeats(w)
        want.append((str(d), len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n,
                     len(w) < 50 or 100 * n > 50 * len(w)))
    assert got == sorted(want)


def test_many_repeated_windows(spark):
    words = [f"w{i % 70}" for i in range(200)] + [f"v{i}" for i in range(300)]
    row = quality.quality_report(table(spark, [(1, " ".join(words))])).first()
    assert row.n_repeat_words == repeats(words)


def test_lines_and_verdict(spark):
    prose = "\n".join(" ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(9)) + "." for i in range(10))
    menu = "home | news | shop | help"
    bad = "\n".join(["no closing mark here at all"] * 3 + [menu] * 3)
    rows = [(1, prose), (2, prose + "\n" + menu + "\nAll rights reserved."), (3, prose[:80] + ".\n" + "\n".join(f"open line {i} of text without end" for i in range(40))),
            (4, bad), (5, prose + "\nWHAT!! IS!! THIS!!")]
    docs = table(spark, rows)
    kept = {r.doc_id: r for r in quality.keep_good(docs).collect()}
    assert set(kept) == {1, 2, 5} and kept[2].text == prose and kept[5].text == prose and kept[1].n_chars == len(prose)
    assert kept[1].asDict().keys() == set(docs.columns) and kept[1].row == "r"


def test_quality_empty(spark):
    assert quality.quality_report(table(spark, [])).count() == 0
    assert quality.keep_good(table(spark, EDGES)).count() == 0


def test_shards(spark):
    rows = [(i, f"text {i % 7}") for i in range(3000)] + EDGES
    got = sharding.shard_plan(table(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == len(rows)
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows}
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.03 < moved < 0.09
    assert sharding.shard_plan(table(spark, [])).count() == 0


def test_blocks_of_slots(spark):
    rows = table(spark, [(i, "t") for i in range(500)] + [(7, "t")] * 200)
    named = sharding.assign_shards(rows.select("doc_id"), weights=[1.0, 3.0])
    one = {(r.doc_id, r.shard, r.slot) for r in sharding.number_rows(named, "shard", "doc_id", [], rows_per_block=20).collect()}
    two = {(r.doc_id, r.shard, r.slot) for r in sharding.number_rows(named, "shard", "doc_id", []).collect()}
    assert one == two and len(one) == 700


def test_weights(spark):
    df = sharding.assign_shards(spark.range(20000).withColumnRenamed("id", "doc_id"), weights=[1, 2, 5])
    share = {r["shard"]: r["count"] / 20000 for r in df.groupBy("shard").count().collect()}
    assert abs(share[0] - .125) < .02 and abs(share[1] - .25) < .02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit("a"), [1, 0])


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_fingerprints(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))) for i in range(150)] + [(200, None), (201, ""), (202, "a"), (203, rows_text := "q w e r t " * 200), (204, rows_text)]
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(table(spark, rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda x: x[0])
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(t)
        assert abs(got[d].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
        assert abs(got[d].near_next - (len(a & c) / len(a | c) if a | c else 1)) < 0.2
    assert got[203].fingerprint == got[204].fingerprint and got[200].fingerprint == got[201].fingerprint == ""


def test_next_ties(spark):
    rows = [(1, "b"), (1, "a"), (None, "z"), (3, "cccc")]
    got = {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(table(spark, rows), rows_per_block=1).collect()}
    assert got == {(3, "cccc"): "a", (1, "a"): "b", (1, "b"): "z", (None, "z"): "cccc"}
    assert fingerprints.fingerprint_report(table(spark, [])).count() == 0
    one = fingerprints.fingerprint_report(table(spark, [(1, "a b c d")])).first()
    assert one.near_next == 1.0


def test_sketch_algebra(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda x: F.xxhash64(x)).alias("a"),
                               F.transform(F.sequence(F.lit(2501), F.lit(5000)), lambda x: F.xxhash64(x)).alias("b"))
    df = df.select(fingerprints.bottom_k(F.col("a"), 512).alias("a"), fingerprints.bottom_k(F.col("b"), 512).alias("b"))
    r = df.select(fingerprints.merge(F.col("a"), F.col("b"), 512).alias("m"), "a", fingerprints.resemblance(F.col("a"), F.col("b"), 512).alias("r"),
                  fingerprints.containment(F.col("b"), F.col("a"), 512).alias("c"), fingerprints.distinct_shingles(F.col("a"), 512).alias("n")).first()
    assert r.m == r.a and abs(r.r - .5) < .1 and r.c > .85 and abs(r.n - 5000) < 700


@pytest.mark.parametrize("few", [0, 50_000])
def test_mixing_marginals(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 50), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"]), None, rng.choice(["x", "y"])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, topic string")
    targets = {"source": {"a": .5, "b": .3, "c": .2}, "lang": {"en": .6}, "topic": {"x": .7, "y": .3}}
    cells = mixing.fitted_cells(mixing.with_marginals(docs, "tokens"), targets).toPandas()
    total = cells.weight.sum()
    assert (cells.groupby("source").weight.sum() / total).round(4).to_dict() == targets["source"]
    assert abs(cells[cells.lang == "en"].weight.sum() / total - .6) < 1e-3 and abs(cells[cells.topic == "x"].weight.sum() / total - .7) < 1e-3
    out = mixing.mixed(docs, targets, .3).toPandas()
    assert abs((out.tokens * out.probability).sum() / out.tokens.sum() - .3) < 1e-6
    kept = out[out.kept]
    assert abs(kept.tokens.sum() / out.tokens.sum() - .3) < .03 and abs(kept[kept.source == "a"].tokens.sum() / kept.tokens.sum() - .5) < .04
    assert mixing.sample(docs, targets, .3).count() == len(kept) and mixing.sample(docs, targets, .3).columns == docs.columns


def test_mixing_edges(spark):
    docs = table(spark, EDGES)
    assert mixing.mix_report(docs).count() == len(EDGES) and mixing.mix_report(table(spark, [])).count() == 0
    assert mixing.sample(docs).columns == docs.columns


@pytest.mark.parametrize("few", [0, 50_000])
def test_raking_goes_on_until_the_marginals_hold(spark, monkeypatch, few):
    # Nearly separable: each source has almost all of its tokens in its own language.
    monkeypatch.setattr(mixing, "FEW_CELLS", few)
    rows = [("a", "en", "x", 10_000), ("a", "de", "x", 10), ("b", "en", "x", 10), ("b", "de", "x", 10_000)]
    docs = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": .6, "b": .4}, "lang": {"en": .45, "de": .55}}
    cells = mixing.fitted_cells(docs, targets).toPandas()
    total = cells.weight.sum()
    for name, want in targets.items():
        got = (cells.groupby(name).weight.sum() / total).to_dict()
        assert all(abs(got[k] - share) < 2e-5 for k, share in want.items())


def test_raking_reports_targets_out_of_reach(spark):
    docs = spark.createDataFrame([("a", "en", "x", 10), ("b", "de", "x", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(RuntimeWarning, match="marginal"):
        mixing.fitted_cells(docs, {"source": {"a": .6, "b": .4}, "lang": {"en": .45, "de": .55}})
