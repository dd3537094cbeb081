"""MinHash near-duplicates by sequential Bayesian verification.

Documents are sets of distinct shingles (two words in a row; a single word
is one shingle).  Two link when the shared ones are at least ``PERCENT`` of
all of theirs.  The result is each document's component under the links.

1. Every text gets a signature of ``BANDS * ROWS`` minima of its shingle
   hashes, 16 bits each.  Equal sets are one node from here on.
2. Nodes that agree in a band of the signature share a bucket and are
   candidates.  A pair at the threshold misses all bands with probability
   ``(1 - 0.8 ** ROWS) ** BANDS``, about 1e-7.
3. Candidates are verified in sequence: after each batch of signature
   places the posterior probability that their similarity reaches the
   threshold, given the matches so far and a uniform prior, must be at least
   ``MISS``, else the pair is dropped.  Survivors are compared by their full sets.
4. In two rounds the members of a bucket are candidates of one member (the
   first, then the last), each confirmed with the one it matches best:
   rows in proportion to members.  In buckets whose members still differ in
   component, the members outside the largest one compare signatures with
   bounded chunks of all members.  First only the best match of each is
   confirmed, which gathers most of what is left of large groups.  Then a
   member that has a survivor in a component that is still another one is
   compared by full sets with all of that component, in bounded chunks, of
   which those are opened whose union its overlap allows to link.  So no
   candidate pair between components is left out, none within one is
   compared, and pairs are never listed: a row says which component to open.

Shingles are compared by 64-bit hashes, equal sets found by their size and 128 bits.

Defined results: NULL and blank texts have the empty set and link with
nothing, not even each other; repeated rows and equal texts are linked;
component ids ignore NULL ids (NULL when there is no other, and then kept).
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.blocks import mix
from phenoframe.llm.components import connected
from phenoframe.llm.running import join_hot
from phenoframe.llm.stages import Scratch

PERCENT = 80
BANDS, ROWS = 40, 5
#: Signature places compared before each look at the posterior, and the posterior below which a pair is dropped.
BATCH, MISS = 25, 1e-6
#: Text bytes hashed at once; members of a bucket that a query asks at once; queries that ask them; pairs of a text in one task.
PIECE_BYTES, CHUNK, QUERIES, PAIRS = 2_000_000, 256, 1024, 200

#: Members of a component that a query opens at once, and queries that open them.
OPEN_CHUNK, OPEN_QUERIES = 128, 256

PLACES = BANDS * ROWS


def least_matches() -> list[int]:
    """For each batch, the fewest matches so far with which a pair stays.

    With a uniform prior the posterior of the similarity after m matches in n
    places is Beta(m + 1, n - m + 1); it exceeds t with the probability that
    a binomial of n + 1 trials at t is at most m.
    """
    t, least = PERCENT / 100, []
    for n in range(BATCH, PLACES + 1, BATCH):
        below = m = 0
        while True:
            below += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log(1 - t))
            if below >= MISS:
                break
            m += 1
        least.append(m)
    return least


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, behind one another, and the edges between texts."""
    known: dict[bytes, int] = {}
    rows = [t.encode().lower().split() for t in texts]
    at = np.fromiter((known.setdefault(w, len(known)) for row in rows for w in row), dtype=np.int64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[at]
    sizes = np.array([len(row) for row in rows], dtype=np.int64)
    text = np.repeat(np.arange(len(rows)), sizes)
    pair = np.r_[text[1:] == text[:-1], False] if len(text) else np.zeros(0, bool)
    single = sizes[text] == 1
    after = np.r_[words[1:], np.zeros(min(1, len(words)), np.uint64)]
    value = np.where(single, mix(words ^ np.uint64(1)), mix(mix(words) + after))
    taken = pair | single
    value, text = value[taken], text[taken]
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])] if len(value) else np.zeros(0, bool)
    value, text = value[new], text[new]
    return value, np.r_[0, np.cumsum(np.bincount(text, minlength=len(rows)))].astype(np.int64)


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16 bits of each place's minimum, a row for each (non-empty) set."""
    rng = np.random.default_rng(11)
    turns, odd = rng.integers(0, 1 << 32, PLACES, dtype=np.uint32), rng.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1)
    low = (value >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), PLACES), dtype=np.uint16)
    for i in range(PLACES):
        least = np.minimum.reduceat((low ^ turns[i]) * odd[i], starts)
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts are about ``PIECE_BYTES`` together."""
    upto = np.cumsum(np.array([len(t) for t in texts.to_pylist()], dtype=np.int64))
    piece = upto // PIECE_BYTES
    edges = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1], True]) if len(piece) else []
    yield from zip(edges[:-1], edges[1:])


SETS = "doc_id {id}, text string, n long, s1 long, s2 long, signature binary"


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step of ``mapInArrow``: size, 128-bit hash and signature of each text's set."""
    for batch in batches:
        for a, b in pieces(batch.column("text")):
            part = batch.slice(a, b - a)
            value, edges = shingles(part.column("text").to_pylist())
            n = np.diff(edges)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signed = [None] * len(n)
            if len(full):
                starts = edges[:-1][full]
                s1[full] = np.add.reduceat(mix(value), starts)
                s2[full] = np.bitwise_xor.reduceat(mix(value + np.uint64(77)), starts)
                for i, row in zip(full, signatures(value, starts)):
                    signed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                                              pa.array(signed, pa.binary())], names=["doc_id", "text", "n", "s1", "s2", "signature"])


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), PLACES)


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step of ``mapInArrow``: the bucket of each node in each band."""
    for batch in batches:
        if not batch.num_rows:
            continue
        signed = matrix(batch.column("signature")).astype(np.uint64).reshape(batch.num_rows, BANDS, ROWS)
        key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (batch.num_rows, BANDS))
        for i in range(ROWS):
            key = mix((key + signed[:, :, i]) * np.uint64(0x9E3779B97F4A7C15))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["key", "node"])


def survivors(one: np.ndarray, other: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of signatures that stay after all batches, and their matches; ``one`` may be a single row for all."""
    left = np.flatnonzero((100 * size >= PERCENT * sizes) & (100 * sizes >= PERCENT * size))
    matches = np.zeros(len(left), dtype=np.int64)
    for i, least in enumerate(least_matches()):
        places = slice(i * BATCH, (i + 1) * BATCH)
        mine = one[left, places] if len(one) > 1 else one[:, places]
        matches += (mine == other[left, places]).sum(axis=1)
        stays = matches >= least
        left, matches = left[stays], matches[stays]
        if not len(left):
            break
    return left, matches


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step of ``mapInArrow``: the pairs ``a, b`` that their signatures do not rule out, with their matches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, other = matrix(batch.column("signed_a")), matrix(batch.column("signed_b"))
        if len(own) == 1:
            own, other = np.repeat(own, 2, axis=0), np.repeat(other, 2, axis=0)
        sizes = [np.resize(batch.column(c).to_numpy(), len(own)) for c in ("n_a", "n_b")]
        left, matches = survivors(own, other, *sizes)
        fits = left < batch.num_rows
        taken = pa.array(left[fits])
        yield pa.RecordBatch.from_arrays([batch.column("a").take(taken), batch.column("b").take(taken), pa.array(matches[fits])], names=["a", "b", "matches"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step of ``mapInArrow``: pairs whose full sets link."""
    for batch in batches:
        for p, q in pieces(batch.column("text_b")):
            part = batch.slice(p, q - p)
            a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
            heads, at = np.unique(a, return_index=True)
            texts_a = part.column("text_a").take(pa.array(at)).to_pylist()
            found = []
            for head, text in zip(heads, texts_a):  # the texts of a batch's heads are taken one by one: they may be long
                mine = np.flatnonzero(a == head)
                own, _ = shingles([text])
                flat, edges = shingles(part.column("text_b").take(pa.array(mine)).to_pylist())
                n = np.diff(edges)
                shared = np.add.reduceat(contained(flat, own).astype(np.int64), edges[:-1])
                found.append(mine[100 * shared >= PERCENT * (len(own) + n - shared)])
            taken = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[taken]), pa.array(b[taken])], names=["a", "b"])


def by_group(told, keys: tuple[str, ...]):
    """Step of ``mapInArrow`` over rows sorted by the long ``keys``: ``told`` of each group, one group in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows = pa.Table.from_batches(held)
            group = np.stack([rows.column(c).to_numpy() for c in keys])
            edges = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0), True])
            for p, q in zip(edges[:-2], edges[1:-1]):
                yield from told(rows.slice(p, q - p))
            held = rows.slice(edges[-2]).to_batches()
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def matches_in_chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each query of a bucket's chunk and each component that it asks: the member that it matches best, of those that the signatures do not rule out."""
    asks = rows.column("asks").to_numpy()
    if asks.all() or not asks.any():
        return
    signed = matrix(rows.column("signature").combine_chunks())
    node, label, n, main = (rows.column(c).to_numpy() for c in ("node", "label", "n", "main"))
    members = np.flatnonzero(~asks)
    found = []
    for q in np.flatnonzero(asks):
        # Of two queries the one of the higher component asks.
        near = members[main[members] | (label[members] < label[q])]
        left, matches = survivors(signed[q:q + 1], signed[near], n[q], n[near])
        order = np.lexsort((-matches, label[near[left]]))
        hit = near[left][order]
        first = np.r_[True, label[hit[1:]] != label[hit[:-1]]] if len(hit) else np.zeros(0, bool)
        found.append(np.stack([np.full(first.sum(), node[q]), node[hit[first]], label[hit[first]], matches[order][first]]))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, np.concatenate(found, axis=1))), names=["a", "b", "label", "matches"])


def links_in_chunk(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each query of a component's chunk a member whose full set links with its own, if there is one.

    The query's overlap with the union of the members' sets bounds its overlap with any of them."""
    asks = rows.column("asks").to_numpy()
    if asks.all() or not asks.any():
        return
    node, texts = rows.column("node").to_numpy(), rows.column("text").combine_chunks()
    members = node[~asks]
    flat, edges = shingles(texts.filter(pa.array(~asks)).to_pylist())
    union, sizes = np.unique(flat), np.diff(edges)
    a, b = [], []
    for q in np.flatnonzero(asks):
        own, _ = shingles([texts[q].as_py()])
        if 100 * contained(own, union).sum() < PERCENT * len(own):
            continue
        shared = np.add.reduceat(contained(flat, own).astype(np.int64), edges[:-1])
        hit = np.flatnonzero(100 * shared >= PERCENT * (len(own) + sizes - shared))
        if len(hit):
            a.append(node[q])
            b.append(members[hit[0]])
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def contained(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted, non-empty known ones."""
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def judged(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (``a``: one of few heads, ``b``) that their signatures do not rule out, with their ``matches``."""
    pairs = scratch.keep(pairs, "pairs")
    heads = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    heads = heads.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("signature").alias("signed_a")), "a")
    both = pairs.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("signature").alias("signed_b")), "b")
    both = join_hot(scratch.keep(both, "signed"), scratch.keep(heads, "heads"), ["a"], "many", pairs.count())
    return both.select("a", "b", "n_a", "n_b", "signed_a", "signed_b").mapInArrow(judge, "a long, b long, matches long")


def confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs whose full sets link.  The text of an ``a`` of many pairs is repeated under salts."""
    pairs = scratch.keep(pairs.select("a", "b"), "survivors")
    heads = scratch.keep(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many")), "heads")
    salts = F.ceil(F.col("many") / PAIRS)
    asked = join_hot(pairs, heads, ["a"], "many", pairs.count()).withColumn("salt", F.pmod(F.xxhash64("b"), salts)).select("a", "b", "salt")
    texts = sets.select(F.col("row").alias("a"), F.col("text").alias("text_a")).join(heads, "a")
    texts = texts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("many")
    asked = asked.join(sets.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b").join(texts, ["a", "salt"])
    return scratch.keep(asked.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"), "links")


def differing(placed: DataFrame, total: int) -> DataFrame:
    """Rows ``key, node, label`` of the buckets whose members are of several components, with the bucket's size and its first and last member."""
    buckets = placed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high"),
                                        F.min("node").alias("first"), F.max("node").alias("last"))
    return join_hot(placed, buckets.where("low <> high").drop("low", "high"), ["key"], "size", total)


def in_chunks(members: DataFrame, asking: DataFrame, chunk: int, block: int, columns: list[str], key: str) -> DataFrame:
    """Members and queries of each ``key`` (with its numbers of either in ``size`` and ``asking``), so that every query meets
    every member in one group of ``key, chunk, block`` of bounded size."""
    chunks, blocks = F.ceil(F.col("size") / chunk), F.ceil(F.col("asking") / block)
    zero, spread = F.lit(0).cast("long"), F.xxhash64("node")
    here = members.select(key, *columns, F.pmod(spread, chunks).alias("chunk"), F.explode(F.sequence(zero, blocks - 1)).alias("block"), F.lit(False).alias("asks"))
    there = asking.select(key, *columns, F.explode(F.sequence(zero, chunks - 1)).alias("chunk"), F.pmod(spread, blocks).alias("block"), F.lit(True).alias("asks"))
    return here.unionByName(there)


def grouped(rows: DataFrame, key: str) -> DataFrame:
    return rows.repartition(key, "chunk", "block").sortWithinPartitions(key, "chunk", "block")


def others(rows: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """For each query of a bucket and each other component in it: the best match ``b`` of ``a`` by signature, among those not
    ruled out (a row for each chunk).  Of each bucket the members outside its largest component are the queries."""
    each = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("many"))
    largest = each.groupBy("key").agg(F.max_by("label", "many").alias("largest"), F.sum("many").alias("size"), (F.sum("many") - F.max("many")).alias("asking"))
    told = join_hot(rows.select("key", "node", "label"), scratch.keep(largest, "largest"), ["key"], "size", rows.count())
    told = told.withColumn("main", F.col("label") == F.col("largest"))
    met = in_chunks(told, told.where("not main"), CHUNK, QUERIES, ["node", "label", "main"], "key").join(nodes.select("node", "n", "signature"), "node")
    keys = ("key", "chunk", "block")
    return grouped(met, "key").mapInArrow(by_group(matches_in_chunk, keys), "a long, b long, label long, matches long")


def opened(asked: DataFrame, equal: DataFrame, labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links of queries ``a`` with components ``label``: each query is compared, by full sets, with all members of the component, in chunks."""
    asked = scratch.keep(asked.select("a", "label").distinct(), "asked")
    sizes = asked.groupBy("label").agg(F.count(F.lit(1)).alias("asking"))
    members = equal.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sizes, "label")
    members = scratch.keep(members, "members")
    number = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.first("asking").alias("asking"))
    number = scratch.keep(number, "sizes")
    members = join_hot(members.select("label", "node"), number, ["label"], "size", members.count())
    asking = join_hot(asked.withColumnRenamed("a", "node"), number, ["label"], "asking", asked.count())
    rows = in_chunks(members, asking, OPEN_CHUNK, OPEN_QUERIES, ["node"], "label").join(sets.select(F.col("row").alias("node"), "text"), "node")
    return scratch.keep(grouped(rows, "label").mapInArrow(by_group(links_in_chunk, ("label", "chunk", "block")), "a long, b long"), "links")


def components(nodes: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label`` of the nodes that link with another."""
    bands = scratch.keep(nodes.select("node", "signature").mapInArrow(band_keys, "key long, node long"), "bands")
    total = bands.count()
    open_ = scratch.keep(differing(bands.withColumn("label", F.col("node")), total), "buckets")
    links, labels = None, None

    def gathered(found: DataFrame) -> None:
        nonlocal links, labels
        links = found if links is None else links.unionByName(found)
        labels = connected(links)

    def label_of(node: str, label: str) -> DataFrame:
        return labels.select(F.col("node").alias(node), F.col("label").alias(label))

    for head in ("first", "last"):
        pairs = open_.where(f"node <> {head}").select(F.col(head).alias("a"), F.col("node").alias("b")).distinct()
        left = judged(pairs, nodes, scratch).groupBy("b").agg(F.max_by("a", "matches").alias("a"))
        gathered(confirmed(left, sets, scratch))
        placed = open_.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_ = scratch.keep(differing(scratch.keep(placed, "placed"), total), "buckets")
    near = scratch.keep(others(open_, nodes, scratch), "near")
    gathered(confirmed(near.groupBy("a").agg(F.max_by("b", "matches").alias("b")), sets, scratch))
    # Components only grow: what is in another one now was in another one when it was found.
    apart = near.select("a", "b").join(label_of("a", "own"), "a", "left").join(label_of("b", "label"), "b", "left")
    apart = apart.select("a", F.coalesce("own", "a").alias("own"), F.coalesce("label", "b").alias("label")).where("own <> label")
    gathered(opened(apart, nodes, labels, sets, scratch))
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` and whether it is ``kept`` as its component's first."""
    scratch = Scratch(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sets = scratch.keep(texts.mapInArrow(sketch, SETS.format(id=id_type)).withColumn("row", F.monotonically_increasing_id()), "sets")
    same = ["n", "s1", "s2"]
    equal = sets.where("n > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    equal = scratch.keep(equal, "equal")
    nodes = scratch.keep(equal.select("node", "n").join(sets.select(F.col("row").alias("node"), "signature"), "node"), "nodes")
    labels = components(nodes, sets, scratch)
    labelled = scratch.keep(equal.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = join_hot(labelled, scratch.keep(least, "least"), ["label"], "members", labelled.count()).select(*same, "component_id", "copies")
    known = join_hot(sets.where("n > 0").select("doc_id", *same), scratch.keep(known, "known"), same, "copies", sets.count())
    every = known.select("doc_id", "n", "component_id").unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    result = every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return scratch.finish(result, "near-duplicates")
