"""Language-model scores from a log-frequency Bloom filter.

Counts of single tokens and of pairs are quantised to levels: each count up
to ``EXACT`` is a level of its own, above it levels grow by a factor.  An n-gram of level q is
put into the filter as the q keys (n-gram, 1) to (n-gram, q), and its level
is read back by probing 1, 2, 3, ... until a probe misses.  Misses are certain,
so levels are never read too low; a false hit, rare by the filter's size,
reads one too high.  A pair is never counted above its first token.

The filter is cut into segments by n-gram hash.  Their number and bits grow
with the n-grams, so the share of false hits is the same at every size, and
nobody holds the filter whole: blocks of documents ask the segments of their
words and pairs (see ``blocks``), and each segment answers with levels in
the order asked.  Tokens are smoothed by a Dirichlet prior:

    p(w)     = (c(w) + 1) / (N + V + 1)
    p(w | v) = (c(v w) + PRIOR * p(w)) / (c(v) + PRIOR)

where v is the token before (the end mark of the text before it for the
first one), and a text's score is the sum of the logarithms to base 10.

The base score needs exact counts of words, which the answers hold too.
Words are compared by 64-bit hashes.

Training texts are those whose CRC-32 of the id modulo ``FOLDS`` is not
``HELD_OUT``; the others are held out.

Defined results: NULL text counts as the empty one, whose only token is the
end mark; a NULL id hashes like the empty text; repeated rows count each; with no training text
all counts are zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm import blocks
from phenoframe.llm.sharding import key_text
from phenoframe.llm.stages import stored

# Fixed values of the split.
FOLDS, HELD_OUT = 7, 2
#: Weight of the single-token probability in tokens seen.
PRIOR = 200.0
#: Counts up to this are kept as they are; above, each level is this factor over the last.
EXACT, FACTOR = 8, 1.15
#: Bits for each key in the filter, and probes of each key.
BITS_PER_KEY, PROBES = 10, 5
#: Bytes that the probes' 32-bit places reach; segments of ``blocks.BUCKET_FACTS`` n-grams stay far below.
REACH = 2 ** 29 - 8
#: The end mark's hash; a word never hashes a space.
END = np.uint64(xxhash.xxh64_intdigest(b" "))
#: Pairs keep 48 bits of their hash: the filter errs far more often than these collide, and less is sent.
PAIR_BITS = np.uint64(2 ** 64 - 2 ** 16)
COUNT = np.dtype([("count", np.uint32)])
KNOWN_COUNT = np.dtype([("count", np.uint64)])
#: Kinds of n-grams; a row of facts names its block and kind as one number.
SINGLE, PAIR = 0, 1
#: What a segment answers a block about one kind; its own sums are in a row of block ``SUMS``.
SUMS = -1
TOLD = "block int, kind int, bucket int, levels binary, counts binary, tokens long, words long"
TOLD_ROWS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("levels", pa.binary()), ("counts", pa.binary()),
                       ("tokens", pa.int64()), ("words", pa.int64())])



def level_counts() -> np.ndarray:
    """Least count of each level, from level 1 on, as far as 2**40."""
    steps = list(range(1, EXACT + 1))
    while steps[-1] < 2 ** 40:
        steps.append(max(steps[-1] + 1, int(steps[-1] * FACTOR)))
    return np.array(steps, dtype=np.int64)


LEVELS = level_counts()
#: Count that a level stands for: the middle of those it covers.
MIDDLES = np.r_[0.0, (LEVELS + np.r_[LEVELS[1:] - 1, LEVELS[-1]]) / 2]


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end mark), and the edges between texts."""
    known: dict[bytes, int] = {}
    rows = [t.encode().lower().split() for t in texts]
    at = np.fromiter((known.setdefault(w, len(known)) for row in rows for w in row), dtype=np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
    sizes = np.array([len(row) for row in rows], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    out = np.full(int(sizes.sum()) + len(rows), END, dtype=np.uint64)
    word = np.ones(len(out), dtype=bool)
    word[ends] = False
    out[word] = hashes[at]
    return out, np.r_[0, ends + 1]


def single_keys(tokens: np.ndarray) -> np.ndarray:
    return blocks.mix(tokens)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return blocks.mix(blocks.mix(before ^ np.uint64(0x5851F42D4C957F2D)) + tokens) & PAIR_BITS


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each one; texts start after an end mark."""
    return np.r_[END, tokens[:-1]] if len(tokens) else tokens


def probe_hashes(keys: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of the probes of (key, level)."""
    h = blocks.mix(keys + np.asarray(level).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return h, (h >> np.uint64(32)) | np.uint64(1)


def probe_place(h: np.ndarray, step: np.ndarray, i: int, size) -> np.ndarray:
    """Bit of the i-th probe in a segment of ``size`` bits."""
    return (((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size) >> np.uint64(32)


def fill_segment(keys: np.ndarray, counts: np.ndarray, most_bytes: int = REACH) -> np.ndarray:
    """Bits of a segment that holds these n-grams; it is never cut to fit."""
    level = np.searchsorted(LEVELS, counts, "right")
    size = max(64, BITS_PER_KEY * int(level.sum()))
    if size > most_bytes * 8:
        raise ValueError(f"a segment needs {size} bits; {most_bytes * 8} are in reach")
    bits = np.zeros(-(-size // 8), dtype=np.uint8)
    size = np.uint64(len(bits) * 8)
    for q in range(1, int(level.max(initial=0)) + 1):
        h, step = probe_hashes(keys[level >= q], q)
        for i in range(PROBES):
            place = probe_place(h, step, i, size)
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
    return bits


class Filter:
    """The segments behind one another."""

    def __init__(self, bits: bytes, sizes: list[int]):
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.start = (np.cumsum(sizes) - sizes).astype(np.uint64)
        self.size = np.array(sizes, dtype=np.uint64) * np.uint64(8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of each n-gram; 0 when it was not seen."""
        level = np.zeros(len(keys), dtype=np.int64)
        segment = blocks.bucket_of(keys, len(self.size))
        rows = np.flatnonzero(self.size[segment] > 0)
        while len(rows):
            h, step = probe_hashes(keys[rows], level[rows] + 1)
            for probes in (range(2), range(2, PROBES)):  # most misses are known after two
                part = segment[rows]
                start, size = self.start[part], self.size[part]
                held = np.ones(len(rows), dtype=bool)
                for i in probes:
                    place = probe_place(h, step, i, size)
                    byte = self.bits[(start + (place >> np.uint64(3))).astype(np.int64)]
                    held &= (byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
                rows, h, step = rows[held], h[held], step[held]
            level[rows] += 1
            rows = rows[level[rows] < len(LEVELS)]
        return level


def is_held_out(key: Column) -> Column:
    return F.crc32(key_text(key).cast("binary")) % FOLDS == HELD_OUT


def blocks_count(number: np.ndarray) -> np.ndarray:
    out = np.zeros(len(number), dtype=COUNT)
    out["count"] = number
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)


def ask_levels(buckets: int):
    """Step 1: a block's different words and pairs, with their training counts in it."""

    def run(rows: pa.Table) -> pa.Table:
        tokens, edges = tokens_of(rows.column("text").to_pylist())
        training = np.repeat(~rows.column("held_out").to_numpy(zero_copy_only=False), np.diff(edges))
        block, out = rows.column("block")[0].as_py(), []
        for kind, asked in ((SINGLE, single_keys(tokens)), (PAIR, pair_keys(before(tokens), tokens))):
            keys, number = summed(asked, training)
            out.extend(blocks.facts(2 * block + kind, keys, blocks_count(number), buckets))
        return blocks.table(out, blocks.FACT_ROWS)

    return run


def tell_levels(rows: pa.Table) -> pa.Table:
    """Step 2: a segment of the filter is filled, and read for each block's n-grams in their order; words with exact counts."""
    keys, values, asker = blocks.read_facts(rows, COUNT)
    bucket = rows.column("bucket")[0].as_py()
    different, number = [], []
    known = np.zeros(len(keys), dtype=np.int64)
    told = np.zeros(len(keys), dtype=KNOWN_COUNT)
    for kind in (SINGLE, PAIR):
        of = np.flatnonzero(asker % 2 == kind)
        found, counts = summed(keys[of], values["count"][of])
        at = np.searchsorted(found, keys[of])
        known[of] = at + sum(map(len, different))
        told["count"][of] = counts[at]
        different.append(found)
        number.append(counts)
    bits = fill_segment(np.concatenate(different), np.concatenate(number))
    segment = Filter(bits.tobytes(), [len(bits)])
    level = np.concatenate([segment.levels(x) for x in different]).astype(np.uint8)[known]
    out = [{"block": SUMS, "kind": SINGLE, "bucket": bucket, "tokens": int(number[SINGLE].sum()), "words": int((number[SINGLE] > 0).sum())}]
    edges = np.flatnonzero(np.r_[True, asker[1:] != asker[:-1], True]) if len(asker) else []
    for a, b in zip(edges[:-1], edges[1:]):
        block, kind = divmod(int(asker[a]), 2)
        out.append({"block": block, "kind": kind, "bucket": bucket, "levels": level[a:b].tobytes(),
                    "counts": blocks.planes(told[a:b]) if kind == SINGLE else None})
    return blocks.table(out, TOLD_ROWS)


def read_levels(told: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Levels of a block's n-grams of one kind in the order of their keys, and the counts of single ones."""
    rows = sorted((r for r in told.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    counts = [blocks.from_planes(r["counts"], KNOWN_COUNT) for r in rows if r["counts"] is not None]
    return (np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8),
            (np.concatenate(counts) if counts else np.zeros(0, KNOWN_COUNT))["count"])


def model_scores(tokens: np.ndarray, singles, pairs, n: int, v: int) -> np.ndarray:
    """Logarithm to base 10 of each token's probability; ``singles`` and ``pairs`` read the levels of n-grams."""
    single = MIDDLES[singles(single_keys(tokens))]
    history = np.r_[MIDDLES[singles(single_keys(np.array([END])))], single[:-1]] if len(tokens) else single
    pair = np.minimum(MIDDLES[pairs(pair_keys(before(tokens), tokens))], np.minimum(history, single))
    alone = (single + 1) / (n + v + 1)
    return np.log10((pair + PRIOR * alone) / (history + PRIOR))


def score_block(n: int, v: int):
    """Step 3: the scores of a block's documents."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        tokens, edges = tokens_of(docs.column("text").to_pylist())
        asked = [np.unique(single_keys(tokens)), np.unique(pair_keys(before(tokens), tokens))]
        (single, exact), (pair, _) = read_levels(told, SINGLE), read_levels(told, PAIR)
        count = exact[np.searchsorted(asked[SINGLE], single_keys(tokens))].astype(np.float64)
        base = np.log10((count + 1) / (n + v + 1))
        score = model_scores(tokens, lambda keys: single[np.searchsorted(asked[SINGLE], keys)],
                             lambda keys: pair[np.searchsorted(asked[PAIR], keys)], n, v)

        def by_text(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, edges[:-1]) if len(edges) > 1 else x[:0]

        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(np.diff(edges), pa.int64()),
            "n_known": pa.array(by_text((count > 0).astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(docs.num_rows, n), pa.int64()),
            "base_score": pa.array(by_text(base), pa.float64()), "score": pa.array(by_text(score), pa.float64())})

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Base score and model score of each document, learned from the training ones."""
    total = blocks.text_bytes(docs)
    placed = blocks.in_blocks(docs, total).withColumn("held_out", is_held_out(F.col("doc_id")))
    buckets = blocks.n_buckets(total // 10)  # a different word or pair of a block for about so many bytes
    asked = placed.groupBy("block").applyInArrow(ask_levels(buckets), blocks.FACTS)
    told = stored(asked.groupBy("bucket").applyInArrow(tell_levels, TOLD), "told")
    sums = told.where(F.col("block") == SUMS).agg(F.sum("tokens"), F.sum("words")).first()
    n, v = int(sums[0] or 0), int(sums[1] or 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.groupBy("block").cogroup(told.where(F.col("block") != SUMS).groupBy("block")).applyInArrow(
        score_block(n, v),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
