"""Token counts, pieces, language model, repeated spans, line templates and the Jaccard join against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from phenoframe.llm import bloom_lm, components, jaccard_groups, line_templates, pieces, prefix_free, token_counts, viterbi
from phenoframe.llm.registry import MODEL

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(MODEL)
SCHEMA = "doc_id long, text string, row string, block string, piece_ids string, lines string, places string"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(d, t, "r", "b", "p", "l", "q") for d, t in rows], SCHEMA)


def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


PARTS = ["a", "b", "t", "he", " ", "  ", "\n", "é", "①", "in", "er", "▁", "<s>", "0", "00", "\t", "日本", "==", "###", "\U0010ffff"]
EDGES = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (5, "A  b"), (None, "a b c d e f g"), (7, "a b c d e f g"), (8, "x" * 40_000)]


def random_texts(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(9)
    extra = ["a" * 5000, " " * 999, "ab" * 3000, "=-" * 500 + "the" * 800, "".join(rng.choice("abcdefghij") for _ in range(8000))]
    rows = EDGES + small(spark) + [(1000 + i, t) for i, t in enumerate(random_texts(3) + extra)]
    got = sorted(str(tuple(r)) for r in token_counts.token_counts(table(spark, rows), PATH).collect())
    counts = [len(library.encode(t or "")) for _, t in rows]
    assert got == sorted(str((d, len((t or "").encode()), n, n > 4096)) for (d, t), n in zip(rows, counts))
    assert token_counts.token_counts(table(spark, []), PATH).count() == 0


def slow_viterbi(word, vocabulary, scores, fallback):
    best = [(0.0, None, None)] + [(-math.inf, None, None)] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + 16) + 1):
            piece = scores.get(word[i:j])
            value = best[i][0] + (piece[1] if piece else fallback if j == i + 1 else -math.inf)
            if value > best[j][0]:
                best[j] = (value, i, [piece[0]] if piece else [int(vocabulary.byte_ids[b]) for b in word[i:j].encode()])
    out, at = [], len(word)
    while at:
        out = best[at][2] + out
        at = best[at][1]
    return out


def test_viterbi(spark):
    vocabulary = pieces.read_vocabulary(PATH)
    encoder = viterbi.Encoder(vocabulary)
    scores = {vocabulary.texts[i]: (int(i), vocabulary.scores[i]) for i in vocabulary.ids}
    texts = random_texts(5, 150) + [t for _, t in small(spark)[:15]]
    ids, edges = encoder.encode(texts)
    for t, a, b in zip(texts, edges[:-1], edges[1:]):
        want = [x for w in pieces.PRE_TOKEN.findall(" " + t) for x in slow_viterbi(w, vocabulary, scores, encoder.fallback)] if t else []
        assert ids[a:b].tolist() == want and encoder.decode(want) == t


def test_round_trip(spark):
    rows = EDGES + [(100 + i, t) for i, t in enumerate(random_texts(6))]
    out = viterbi.encode_documents(table(spark, rows), PATH)
    got = viterbi.decode_documents(out.withColumnRenamed("text", "was"), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r.text is not None) == sorted((str(d), t) for d, t in rows if t is not None)
    assert all(r.text == r.was and (r.round_trip is (None if r.text is None else True)) for r in got)
    assert {r.n_pieces for r in got if r.was is None} == {None} and {r.n_pieces for r in got if r.was == ""} == {0}
    assert viterbi.encode_documents(table(spark, []), PATH).count() == 0


def test_language_model(spark):
    rows = EDGES[:-1] + [(100 + d, t) for d, t in small(spark)]
    got = {(str(r.doc_id), r.n_tokens, r.held_out): r for r in bloom_lm.score_documents(table(spark, rows)).collect()}
    words = [(d, [*(t or "").encode().lower().split(), b" "], zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2) for d, t in rows]
    single, pair = Counter(), Counter()
    for _, w, held in words:
        if not held:
            single.update(w)
            pair.update(zip([b" ", *w], w))
    n, v = sum(single.values()), len(single)
    error = []
    for d, w, held in words:
        r = got[str(d), len(w), held]
        assert r.n_known == sum(single[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((single[x] + 1) / (n + v + 1)) for x in w))
        prior = bloom_lm.PRIOR
        exact = sum(math.log10((pair[h, x] + prior * (single[x] + 1) / (n + v + 1)) / (single[h] + prior)) for h, x in zip([b" ", *w], w))
        error.append(abs(exact - r.score) / len(w))
    assert np.mean(error) < 0.02
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert bloom_lm.score_documents(table(spark, [])).count() == 0


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2 ** 63, 20000).astype(np.uint64) * np.uint64(2))
    counts = rng.geometric(0.2, len(keys)) ** 2
    bits = bloom_lm.fill_segment(keys, counts, 1 << 20)
    held = bloom_lm.Filter(bits.tobytes(), [len(bits)])
    want = np.searchsorted(bloom_lm.LEVELS, counts, "right")
    level = held.levels(keys)
    assert (level >= want).all() and (level == want).mean() > 0.97
    assert (held.levels(keys + np.uint64(1)) > 0).mean() < 0.03


def slow_removal(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + 200] for r in raw for i in range(len(r) - 199))
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - 199):
            if count[r[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        kept = bytes(x for x, g in zip(r, gone) if not g)
        yield len(r), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


def test_repeated_spans(spark, monkeypatch):
    rng = random.Random(5)
    bases = ["".join(rng.choice("ab ") for _ in range(700)) for _ in range(4)]

    def noise():
        return " ".join(f"w{rng.randrange(40)}" for _ in range(60))

    rows = EDGES[:-1] + [(20, "a" * 1000), (21, "ab" * 300), (21, "ab" * 300), (22, "x" * 199), (23, "x" * 200), (24, "é" * 150)]
    for i in range(60):
        k = rng.randrange(700)
        rows.append((30 + i, noise() + bases[i % 4][k:k + rng.choice([198, 199, 200, 201, 250, 400])] + noise()))
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in prefix_free.repeats_report(table(spark, rows)).collect())
    assert got == sorted(str((d, *x)) for (d, _), x in zip(rows, slow_removal([t for _, t in rows])))
    assert prefix_free.repeats_report(table(spark, [])).count() == 0


def test_parse_across_segments(monkeypatch):
    rng = random.Random(8)
    data, edges = prefix_free.join_texts(["".join(rng.choice("abc ") for _ in range(rng.randint(0, 3000))) for _ in range(20)])
    whole = prefix_free.parse(data, edges)
    for size in (700, 1024):
        monkeypatch.setattr(prefix_free, "SEGMENT", size)
        monkeypatch.setattr(prefix_free, "SIZE", size + prefix_free.PLACES + 2 * prefix_free.SPAN)
        assert all((a == b).all() for a, b in zip(whole, prefix_free.parse(data, edges)))


def slow_lines(rows, least):
    leaf, places, parsed = defaultdict(set), defaultdict(set), []
    for d, t in rows:
        family = line_templates.family_of(t or "", {})
        for p, line in enumerate((t or "").split("\n")):
            w = line_templates.line_words(line)
            if w:
                k = (len(w), tuple(w[:line_templates.DEPTH]))
                parsed.append(((d, t or ""), p, w, k, family))
                leaf[k].add(family)
                for i, x in enumerate(w):
                    places[k, i, x].add(family)
    families, texts, of = defaultdict(set), defaultdict(set), {}
    for row, p, w, k, family in parsed:
        shape = tuple(x if len(places[k, i, x]) >= least else None for i, x in enumerate(w))
        if len(leaf[k]) >= least and 100 * sum(x is not None for x in shape) >= line_templates.CONSTANT_PERCENT * len(w):
            of[row, p] = (k, shape)
            families[k, shape].add(family)
            texts[k, shape].add(row[1])
    return {at for at, k in of.items() if len(families[k]) >= least and 2 * len(families[k]) >= len(texts[k])}


def template_rows():
    rng = random.Random(1)
    letters = [f"w{chr(97 + i)}" for i in range(26)]
    rows = list(EDGES)
    for i in range(40):
        lines = [" ".join(rng.choice(letters) for _ in range(12)) for _ in range(4)]
        lines.insert(rng.randrange(4), f"page {i} of the big list by {rng.choice(letters)}{i} now here")
        lines.insert(rng.randrange(4), f"user name is {rng.choice(letters)} and the rest stays as it is")
        rows.append((10 + i, "\n".join(lines)))
    copies = [" ".join(rng.choice(letters) for _ in range(60)) + "\none more line of the copies " for _ in range(1)] * 30
    return rows + [rows[20]] * 3 + [(100 + i, t + str(i)) for i, t in enumerate(copies)]


def test_line_templates(spark):
    rows = template_rows()
    gone = slow_lines(rows, 5)
    assert gone and not any(row[0] and row[0] >= 100 for row, _ in gone)  # near copies keep their own lines
    got = sorted(str((r.doc_id, r.n_dropped, r.cleaned)) for r in line_templates.drop_recurring_lines(table(spark, rows), 5).collect())
    want = []
    for d, t in rows:
        kept = [x for p, x in enumerate((t or "").split("\n")) if ((d, t or ""), p) not in gone]
        want.append(str((d, len((t or "").split("\n")) - len(kept), None if t is None else "\n".join(kept))))
    assert got == sorted(want)
    assert line_templates.template_report(table(spark, [])).count() == 0


def test_documents_of_recurring_lines_go(spark):
    rows = [(i, "the same short line everywhere\n" + " ".join(f"v{chr(97 + i)}{chr(97 + j)}" for j in range(20))) for i in range(20)]
    rows += [(50, "the same short line everywhere"), (51, "")]
    out = line_templates.without_recurring_lines(table(spark, rows))
    assert out.columns == table(spark, rows).columns and {r.doc_id for r in out.collect()} == {*range(20), 51}
    assert not out.where("text like '%everywhere%'").count()


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def slow_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)], [find(i) for i in range(len(rows))]


def near_copies(seed=5, groups=6, size=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = list(EDGES)
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(10, 150))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < .3:
                w = w[:rng.randint(int(len(w) * .6), len(w))]
            rows.append((10 + len(rows), " ".join(w)))
    return rows


@pytest.mark.parametrize("group,chunk,rounds", [(400, 200, 3), (3, 2, 1), (3, 4, 0)])
def test_components(spark, monkeypatch, group, chunk, rounds):
    monkeypatch.setattr(jaccard_groups, "GROUP_SETS", group)
    monkeypatch.setattr(jaccard_groups, "CHUNK_SETS", chunk)
    monkeypatch.setattr(jaccard_groups, "ROUNDS", rounds)
    rows = near_copies()
    got = sorted(str(tuple(r)) for r in jaccard_groups.document_components(table(spark, rows)).collect())
    assert got == sorted(map(str, slow_components(rows)[0]))


def test_keep_one(spark):
    rows = near_copies(seed=6, groups=3)
    kept = jaccard_groups.keep_one(table(spark, rows))
    of = slow_components(rows)[1]
    assert kept.columns == table(spark, rows).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    blank = [x for x in rows if not (x[1] or "").split()]
    heads = {}
    for row, root in zip(rows, of):
        if row not in blank:
            heads.setdefault(root, []).append(row[0] if row[0] is not None else math.inf)
    assert sum(got.values()) == len(blank) + len(heads)
    assert sorted(x for (x, t) in got if x is not None and (t or "").split()) == sorted(min(v) for v in heads.values() if min(v) < math.inf)
    assert jaccard_groups.document_components(table(spark, [])).count() == 0 and jaccard_groups.keep_one(table(spark, [])).count() == 0


@pytest.mark.parametrize("stars,queries", [(0, 2), (3, 1)])
def test_components_whatever_the_stars_leave(spark, monkeypatch, stars, queries):
    for name, value in {"GROUP_SETS": 3, "CHUNK_SETS": 2, "ROUNDS": 0, "STARS": stars, "QUERY_SETS": queries}.items():
        monkeypatch.setattr(jaccard_groups, name, value)
    rows = near_copies(seed=8, groups=4, size=30)
    got = sorted(str(tuple(r)) for r in jaccard_groups.document_components(table(spark, rows)).collect())
    assert got == sorted(map(str, slow_components(rows)[0]))


def test_queries_do_not_grow_with_the_pairs_of_a_group(spark, monkeypatch):
    # Texts of which four fifths are one passage: each pair shares rows of the matrix and does not link.
    rng = random.Random(4)
    passage = made_words(rng, 160)
    rows = [(i, " ".join(passage + made_words(rng, 36))) for i in range(60)]
    asked, keep = [], jaccard_groups.Scratch.keep

    def count(self, df, name):
        kept = keep(self, df, name)
        if name == "asked":
            asked.append(kept.count())
        return kept

    monkeypatch.setattr(jaccard_groups.Scratch, "keep", count)
    got = {r.doc_id: r.component_id for r in jaccard_groups.document_components(table(spark, rows)).collect()}
    assert got == {i: i for i, _ in rows}
    assert sum(asked) <= 3 * len(rows)


def test_connected(spark):
    links = [(i, i + 1) for i in range(10, 40)] + [(50, 3), (3, 4), (60, 60)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 50: 3, 3: 3, 4: 3}


def test_blocks_pack():
    from phenoframe.llm import blocks
    keys = np.sort(np.random.default_rng(0).integers(0, 2 ** 63, 1000).astype(np.uint64) * np.uint64(2))
    assert (blocks.unpack(blocks.pack(keys)) == keys).all() and len(blocks.unpack(blocks.pack(keys[:0]))) == 0
    values = np.array([(1, 2), (3, 70000)], dtype=[("a", np.uint8), ("b", np.uint32)])
    assert (blocks.from_planes(blocks.planes(values), values.dtype) == values).all()


def test_filter_error_is_the_same_at_every_size():
    # The answers of one segment, asked by a training block and a held-out one; bits follow the n-grams, and none is cut.
    rng = np.random.default_rng(2)
    for size in (2_000, 200_000):
        keys = np.unique(rng.integers(0, 2 ** 47, size).astype(np.uint64) << np.uint64(16))
        seen, unseen = keys[::2], keys[1::2]
        rows = [{"bucket": 0, "block": 2 * block + bloom_lm.PAIR, "number": len(k), "keys": bloom_lm.blocks.pack(k),
                 "values": bloom_lm.blocks.planes(bloom_lm.blocks_count(np.full(len(k), count)))} for block, k, count in ((0, seen, 3), (1, unseen, 0))]
        told = bloom_lm.tell_levels(bloom_lm.blocks.table(rows, bloom_lm.blocks.FACT_ROWS)).to_pylist()
        level = {r["block"]: np.frombuffer(r["levels"], np.uint8) for r in told if r["block"] >= 0}
        assert (level[0] >= 3).all() and (level[0] == 3).mean() > 0.97 and (level[1] > 0).mean() < 0.03
    with pytest.raises(ValueError):  # too few bytes are an error, not a filter of false hits
        bloom_lm.fill_segment(seen, np.full(len(seen), 3), 1000)
    assert not hasattr(bloom_lm, "MAX_FILTER_BYTES")


def made_words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_near_copies_do_not_keep_a_recurring_line(spark):
    # 40 unrelated documents and 300 near copies hold one line; the copies' own line stays.
    rng = random.Random(3)
    line = " ".join(made_words(rng, 10))
    rows = [(i, line + "\n" + " ".join(made_words(rng, 160))) for i in range(40)]
    base, own = made_words(rng, 160), " ".join(made_words(rng, 12))
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(160), 2):
            copy[at] = made_words(rng, 1)[0]
        rows.append((1000 + i, "\n".join([" ".join(copy[:80]), own, line, " ".join(copy[80:])])))
    out = {r.doc_id: r.cleaned.split("\n") for r in line_templates.drop_recurring_lines(table(spark, rows)).collect()}
    assert not any(line in x for x in out.values())
    assert all(own in x and len(x) == 3 for d, x in out.items() if d >= 1000) and all(len(x) == 1 for d, x in out.items() if d < 1000)


def test_long_passage_does_not_make_copies(spark):
    # Unrelated documents of which a shared line is two thirds: few least shingles of the whole texts lie outside it.
    rng = random.Random(6)
    line = " ".join(made_words(rng, 200))
    rows = [(i, line + "\n" + " ".join(made_words(rng, 100))) for i in range(16)]
    assert len({line_templates.family_of(t, {}) for _, t in rows}) < line_templates.LEAST
    out = line_templates.drop_recurring_lines(table(spark, rows)).collect()
    assert len(out) == 16 and all(r.n_dropped == 1 and line not in r.cleaned for r in out)


def test_families_outside_a_line():
    rng = random.Random(7)
    for counts in ([3], [1, 1], [4, 0, 3], [10, 5, 0, 20], [0, 6, 7]):
        text = "\n".join(" ".join(made_words(rng, n)) for n in counts)
        value = line_templates.shingle_hashes(text, {})
        line = [i for i, n in enumerate(counts) for _ in range(n)]
        for p, family in enumerate(line_templates.families_of(value, counts)):
            clear = [int(v) >> 1 for i, v in enumerate(value) if p not in line[i:i + 5]]
            if not counts[p]:
                continue  # lines without a word are not counted
            assert family == min(clear or [int(v) >> 1 for v in value])
            got = line_templates.read_sketch(line_templates.sketch_of(value, counts), [p])[1]
            assert sorted(got.tolist()) == sorted(int(v) >> 32 for i, v in enumerate(value) if p not in line[i:i + 5])


def test_false_hits_of_a_probe_round():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2 ** 63, 400_000).astype(np.uint64))
    bits = bloom_lm.fill_segment(keys[::2], np.full(len(keys[::2]), 2))
    assert (bloom_lm.Filter(bits.tobytes(), [len(bits)]).levels(keys[1::2]) > 0).mean() < 0.012


def test_lines_are_spelled_as_one_text_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(line_templates, "BATCH_CHARS", 50)
    texts = [t or "" for _, t in EDGES] + random_texts(9, 40)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["row", "text"])
    found = [x for b in line_templates.spell([batch]) for x in b.to_pylist()]
    words = {" ".join(line_templates.line_words(line)) for t in texts for line in t.split("\n")} - {""}
    assert {x["words"] for x in found} == words and len({x["line"] for x in found}) == len(words)
    parts = list(line_templates.parse([batch]))
    assert len(parts) > 10 and {line for p in parts for line in p.column("line").to_pylist()} == {x["line"] for x in found}
