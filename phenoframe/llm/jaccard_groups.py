"""Exact Jaccard join of shingle sets by a token-group matrix.

Documents are sets of distinct shingles (five words in a row; a shorter text
is one shingle).  Two link when the shared ones are at least ``PERCENT`` of
all of theirs.  The result is each document's component under the links.

1. Equal texts are one document from here on.
2. Shingles are put in one order for the whole corpus, the rarest first
   (blocks ask the buckets of their shingles how many texts hold them).  A
   set that links with another shares with it one of its first
   ``n - ceil(n * PERCENT / 100) + 1`` shingles.  A set whose first shingles
   are all its own links with nothing and is done.
3. Partition: the others are dealt to groups by their least shingle under a
   random order; the links within a group of bounded size make clusters.
   A second round with a new order deals only the first set of each.
4. Matrix: the first shingles of all members make the rows, bounded chunks of
   labels (clusters, then what has been joined so far) the columns.  A set
   queries chunks of other labels with which it shares a row.  A chunk keeps
   the union of its members' shingles; the query's overlap with the union
   bounds its overlap with any member, and only chunks where the bound
   qualifies are opened and their members compared.  First each row answers
   with one chunk, so that queries are in proportion to the matrix and not to
   its pairs; then all labels that still share a row are compared where the
   places of the shared shingle leave room for enough others.  No pair of
   sets is skipped otherwise, so every link between labels is found.
5. Components of the links.

Shingles and texts are compared by 64-bit and 128-bit hashes.

Defined results: NULL and blank texts have the empty set and link with
nothing, not even each other; repeated rows and equal texts are linked;
component ids ignore NULL ids (NULL when there is no other).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm import blocks
from phenoframe.llm.components import connected
from phenoframe.llm.stages import Scratch, small
from phenoframe.llm.text import BLANKS

SHINGLE_WORDS = 5
PERCENT = 75
#: Sets that one task compares with each other, and that a chunk of a cluster holds.
GROUP_SETS, CHUNK_SETS = 300, 200
#: Sets that one task compares with a chunk.
QUERY_SETS = 1_000
#: Rounds of grouping before the matrix, and at most of stars over all rows of the matrix.
ROUNDS, STARS = 2, 8
COUNT = np.dtype([("count", np.uint32)])
FREQUENT, CHOSEN = 0, 1


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, behind one another, and the edges between texts."""
    known: dict[bytes, int] = {}
    rows = [t.encode().lower().split() for t in texts]
    at = np.fromiter((known.setdefault(w, len(known)) for row in rows for w in row), dtype=np.int64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))[at]
    sizes = np.array([len(row) for row in rows], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    length = np.minimum(sizes, SHINGLE_WORDS)
    number = np.where(sizes > 0, sizes - length + 1, 0)
    text = np.repeat(np.arange(len(rows)), number)
    begin = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + starts[text]
    value = np.zeros(len(begin), dtype=np.uint64)
    for i in range(SHINGLE_WORDS):
        inside = i < length[text]
        value = np.where(inside, blocks.mix(value + words[np.minimum(begin + i, max(0, len(words) - 1))] if len(words) else value) + np.uint64(i + 1), value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])] if len(value) else np.zeros(0, bool)
    value, text = value[new], text[new]
    return value, np.r_[0, np.cumsum(np.bincount(text, minlength=len(rows)))].astype(np.int64)


def chosen_texts(docs: pa.Table, told: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Row hashes and texts of the documents that stand for their equals, each once."""
    rows = docs.column("row").to_numpy().view(np.uint64)
    keys, _ = blocks.read_answers(told, CHOSEN, COUNT)
    _, held = blocks.look_up(rows, keys)
    _, first = np.unique(rows, return_index=True)
    of = first[held[first]]
    return rows[of], docs.column("text").take(pa.array(of)).to_pylist()


def pack_chosen(rows: pa.Table) -> pa.Table:
    keys = np.unique(rows.column("row").to_numpy().view(np.uint64))
    return blocks.table([blocks.answer(rows.column("block")[0].as_py(), CHOSEN, keys, np.zeros(len(keys), COUNT))], blocks.ANSWER_ROWS)


def ask_frequencies(buckets: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return blocks.table([], blocks.FACT_ROWS)
        value, _ = shingle_sets(chosen_texts(docs, told)[1])
        keys = np.sort(value)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        count = np.zeros(len(first), dtype=COUNT)
        count["count"] = np.diff(np.r_[first, len(keys)])
        return blocks.table(blocks.facts(docs.column("block")[0].as_py(), keys[first], count, buckets), blocks.FACT_ROWS)

    return run


def tell_frequent(rows: pa.Table) -> pa.Table:
    """For each block, its shingles that more than one text holds, with the number of texts."""
    keys, values, block = blocks.read_facts(rows, COUNT)
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    total = np.zeros(len(keys), dtype=COUNT)
    if len(keys):
        sums = np.add.reduceat(values["count"][order].astype(np.int64), first)
        total["count"][order] = np.repeat(sums, np.diff(np.r_[first, len(keys)]))
    told = np.flatnonzero(total["count"] >= 2)
    edges = np.flatnonzero(np.r_[True, block[told][1:] != block[told][:-1], True]) if len(told) else []
    return blocks.table((blocks.answer(int(block[told[a]]), FREQUENT, keys[told[a:b]], total[told[a:b]])
                         for a, b in zip(edges[:-1], edges[1:])), blocks.ANSWER_ROWS)


SETS = "node long, size int, firsts array<long>, places array<int>, shingles binary"


def order_sets(docs: pa.Table, told: pa.Table) -> pa.Table:
    """Each set's size; for those that may link, the shared ones among its first shingles, and all of them."""
    nodes, texts = chosen_texts(docs, told) if docs.num_rows else (np.zeros(0, np.uint64), [])
    value, edges = shingle_sets(texts)
    keys, count = blocks.read_answers(told, FREQUENT, COUNT)
    at, held = blocks.look_up(value, keys)
    often = np.ones(len(value), dtype=np.int64)
    often[held] = count["count"][at[held]]
    sizes = np.diff(edges)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((value, often, text))
    firsts = sizes - (sizes * PERCENT + 99) // 100 + 1
    place = np.arange(len(value)) - np.repeat(edges[:-1], sizes)
    shared = (place < firsts[text]) & (often[order] >= 2)
    taken = order[shared]
    per = np.bincount(text[taken], minlength=len(sizes))
    parts = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
    lists = pa.ListArray.from_arrays(parts, pa.array(value[taken].view(np.int64)))
    places = pa.ListArray.from_arrays(parts, pa.array(place[shared], pa.int32()))
    blobs = [value[a:b].tobytes() if p else None for a, b, p in zip(edges[:-1], edges[1:], per)]
    return pa.table({"node": pa.array(nodes.view(np.int64)), "size": pa.array(sizes, pa.int32()), "firsts": lists, "places": places, "shingles": pa.array(blobs, pa.binary())})


def sets_of(rows: pa.Table, column: str = "shingles") -> list[np.ndarray]:
    return [np.frombuffer(blob, np.uint64) for blob in rows.column(column).to_pylist()]


def overlaps(one: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Shared shingles of a set with each of several sets behind one another."""
    _, held = blocks.look_up(flat, one)
    return np.add.reduceat(held.astype(np.int64), edges[:-1]) if len(edges) > 1 else np.zeros(0, np.int64)


def links(shared, a, b):
    return 100 * shared >= PERCENT * (a + b - shared)


def gather(rows: pa.Table) -> pa.Table:
    """Sets of a group that links within it connect to an earlier one: (node, head)."""
    node = rows.column("node").to_numpy()
    size = rows.column("size").to_numpy().astype(np.int64)
    order = np.lexsort((node, size))
    node, size, sets = node[order], size[order], sets_of(rows.take(pa.array(order)))
    left = np.arange(len(node))
    members, heads = [], []
    while len(left) > 1:
        head, left = left[0], left[1:]
        reached = [head]
        while reached and len(left):
            one = reached.pop()
            near = left[(PERCENT * size[left] <= 100 * size[one]) & (PERCENT * size[one] <= 100 * size[left])]
            if not len(near):
                continue
            edges = np.r_[0, np.cumsum(size[near])]
            joined = near[links(overlaps(sets[one], np.concatenate([sets[i] for i in near]), edges), size[one], size[near])]
            members.append(node[joined])
            heads.append(np.full(len(joined), node[head]))
            reached.extend(joined.tolist())
            left = np.setdiff1d(left, joined, assume_unique=True)
    return pa.table({"node": pa.array(np.concatenate(members) if members else node[:0], pa.int64()),
                     "head": pa.array(np.concatenate(heads) if heads else node[:0], pa.int64())})


def open_chunk(rows: pa.Table) -> pa.Table:
    """Pairs (``a``, ``b``) of labels: sets that ask (``own`` is their label) and link with a member of the chunk of another label."""
    asks = rows.column("own").is_valid()
    members, queries = rows.filter(pc.invert(asks)), rows.filter(asks)
    found = set()
    if members.num_rows and queries.num_rows:
        label, size = members.column("label")[0].as_py(), members.column("size").to_numpy().astype(np.int64)
        flat, edges = np.concatenate(sets_of(members)), np.r_[0, np.cumsum(size)]
        union = np.unique(flat)
        for own, one in zip(queries.column("own").to_pylist(), sets_of(queries)):
            if (own, label) in found:  # members of a chunk are of one label: one link joins it
                continue
            _, held = blocks.look_up(one, union)
            if 100 * held.sum() >= PERCENT * len(one) and links(overlaps(one, flat, edges), len(one), size).any():
                found.add((own, label))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def least_shingle(round_: int):
    """Step of ``mapInArrow``: the least shingle of each set under the order of a round."""
    salt = blocks.mix(np.array([round_ + 1], dtype=np.uint64))

    def run(batches):
        for batch in batches:
            least = [int(blocks.mix(np.frombuffer(b, np.uint64) ^ salt).min().view(np.int64)) for b in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])

    return run


def clusters(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``head`` of the sets that may link: heads stand for themselves and those that joined them."""
    heads = scratch.keep(sets.select("node", F.col("node").alias("head")), "heads")
    for round_ in range(ROUNDS):
        firsts = sets.join(heads.where("node = head").select("node"), "node").select("node", "size", "shingles")
        marked = firsts.mapInArrow(least_shingle(round_), "node long, size int, shingles binary, least long")
        # Large groups are split evenly.
        many = marked.groupBy("least").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / GROUP_SETS))
        parted = marked.join(many, "least").select("node", "size", "shingles", "least", part.alias("part")).repartition("least", "part")
        joined = parted.groupBy("least", "part").applyInArrow(gather, "node long, head long")
        joined = scratch.keep(joined.select(F.col("node").alias("head"), F.col("head").alias("to")), "joined")
        heads = scratch.keep(heads.join(joined, "head", "left").select("node", F.coalesce("to", "head").alias("head")), "heads")
    return heads


def fits(size: Column, place: Column, other: Column) -> Column:
    """Whether a set of one size may link with one of the other, their first common shingle at that place: what follows must be enough."""
    return 100 * size - (100 + PERCENT) * place >= PERCENT * other


def ask(sets: DataFrame, placed: DataFrame, round_: int, star: int | None) -> DataFrame:
    """Sets ``node`` of label ``own`` and the chunks (``label``, ``chunk``) of other labels that they query.

    ``placed`` has the label and the chunk of each set.  With ``star`` each
    row of the matrix answers with one member, drawn by the round's hash, and
    the sets of other labels query its chunk: by one of their rows only (1:
    the most frequent, 2: the one before) or by all (0).  Without, sets query
    every chunk of a lower label that may hold a set they link with.
    """
    sets = sets.withColumn("size", F.col("size").cast("long"))
    rows = sets.select("node", "size", F.explode(F.arrays_zip("firsts", "places")).alias("first")).join(placed, "node")
    rows = rows.select("node", "size", "label", "chunk", F.col("first.firsts").alias("shingle"), F.col("first.places").cast("long").alias("place"))
    sized = (100 * F.col("size") >= PERCENT * F.col("least")) & (100 * F.col("most") >= PERCENT * F.col("size"))
    near = fits(F.col("size"), F.col("place"), F.col("least"))
    if star is None:
        reach = F.max(100 * F.col("size") - (100 + PERCENT) * F.col("place")).alias("reach")
        columns = rows.groupBy("shingle", "label", "chunk").agg(F.min("size").alias("least"), F.max("size").alias("most"), reach)
        shared = columns.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("shingle")
        columns = columns.join(shared, "shingle", "left_semi")
        rows = rows.join(shared, "shingle", "left_semi").select("shingle", "node", F.col("label").alias("own"), "size", "place")
        wanted = (F.col("own") > F.col("label")) & sized & near & (F.col("reach") >= PERCENT * F.col("size"))
    else:
        one = F.min(F.struct(F.xxhash64("node", F.lit(round_)), "label", "chunk", F.col("size").alias("least"), F.col("place").alias("at"))).alias("one")
        drawn = rows.groupBy("shingle").agg(one, F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
        columns = drawn.select("shingle", "one.label", "one.chunk", "one.least", F.col("one.least").alias("most"), "one.at")
        wanted = (F.col("own") != F.col("label")) & sized
        if star:
            rows = sets.select("node", "size", F.try_element_at("firsts", F.lit(-star)).alias("shingle"), F.lit(0).cast("long").alias("place")).join(placed, "node")
        else:
            wanted = wanted & near & fits(F.col("least"), F.col("at"), F.col("size"))
        rows = rows.select("shingle", "node", F.col("label").alias("own"), "size", "place")
    return rows.join(columns, "shingle").where(wanted).select("node", "own", "label", "chunk").distinct()


def opened_links(sets: DataFrame, placed: DataFrame, asked: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (``a``, ``b``) that the queries find linked; a chunk that many sets query is opened by several tasks."""
    parts = asked.groupBy("label", "chunk").agg(F.ceil(F.count(F.lit(1)) / QUERY_SETS).alias("parts"))
    members = placed.join(parts, ["label", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    queries = asked.join(parts, ["label", "chunk"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    names = ["node", "label", "chunk", "part"]
    opened = scratch.keep(members.select(*names, F.lit(None).cast("long").alias("own")).union(queries.select(*names, "own")), "opened")
    rows = sets.select("node", "size", "shingles").join(small(opened), "node")
    return rows.groupBy("label", "chunk", "part").applyInArrow(open_chunk, "a long, b long").distinct()


def in_chunks(labels: DataFrame) -> DataFrame:
    """``labels`` with the ``chunk`` of each set."""
    many = labels.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / CHUNK_SETS).alias("chunks")).where("chunks > 1")
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0).cast("long"))
    return labels.join(many, "label", "left").select("node", "label", chunk.alias("chunk"))


def set_labels(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and the ``label`` of its component, for sets that may link.

    Star rounds query one chunk a row, so that their rows are in proportion
    to the matrix, and join what they find linked; by another member each
    time, until they find nothing.  The last round compares all labels that still
    share a row, so no link is lost whatever the stars left.
    """
    labels = scratch.keep(clusters(sets, scratch).select("node", F.col("head").alias("label")), "labels")
    idle = False
    for round_, star in enumerate([1, 2, *[0] * STARS, None]):
        if star == 0 and idle:
            continue
        placed = scratch.keep(in_chunks(labels), "placed")
        asked = scratch.keep(ask(sets, placed, round_, star), "asked")
        found = scratch.keep(opened_links(sets, placed, asked, scratch), "links")
        idle = not found.limit(1).count()
        if not idle:
            moved = connected(found).select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = scratch.keep(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    return labels


def labelled(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, text hashes ``t1`` and ``t2``, ``n_shingles``, ``component_id`` and ``label`` of its component."""
    scratch = Scratch(docs)
    total = blocks.text_bytes(docs)
    buckets = blocks.n_buckets(total // 6)  # a shingle for about six bytes
    placed = blocks.in_blocks(docs, total)
    equal = placed.select("doc_id", "row", "block", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    chosen = equal.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "row", "block")).alias("one"), F.min("doc_id").alias("least_id"))
    chosen = scratch.keep(chosen.select("t1", "t2", "least_id", F.col("one.row").alias("row"), F.col("one.block").alias("block")), "chosen")
    picked = chosen.select("row", "block").groupBy("block").applyInArrow(pack_chosen, blocks.ANSWERS)
    by_block = placed.groupBy("block")
    asked = by_block.cogroup(picked.groupBy("block")).applyInArrow(ask_frequencies(buckets), blocks.FACTS)
    told = asked.groupBy("bucket").applyInArrow(tell_frequent, blocks.ANSWERS).unionByName(picked)
    ordered = scratch.keep(by_block.cogroup(told.groupBy("block")).applyInArrow(order_sets, SETS), "ordered")
    sets = ordered.where("shingles is not null")
    labels = set_labels(sets, scratch)
    # Every text: its size, label and the least id in its component.
    texts = (ordered.select(F.col("node").alias("row"), "size").join(labels.withColumnRenamed("node", "row"), "row", "left")
             .join(chosen.select("t1", "t2", "row", "least_id"), "row")
             .select("t1", "t2", F.col("size").cast("long").alias("n_shingles"), F.coalesce("label", "row").alias("label"), "least_id"))
    texts = scratch.keep(texts, "texts")
    least = texts.groupBy("label").agg(F.min("least_id").alias("component_id"))
    known = texts.join(least, "label")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    result = equal.select("doc_id", "t1", "t2").join(known, ["t1", "t2"]).select(
        "doc_id", "t1", "t2", "n_shingles", own.alias("component_id"), "label")
    return scratch.finish(result, "components")


def document_components(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id, in the columns of ``docs``; empty texts all stay."""
    names = docs.columns
    found = labelled(docs).select("doc_id", "t1", "t2", "n_shingles", "label")
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    heads = found.where("n_shingles > 0").groupBy("label").agg(F.min(key).alias("head")).select("head.doc_id", "head.t1", "head.t2")
    heads = heads.union(found.where("n_shingles = 0").select("doc_id", "t1", "t2").distinct())
    text = F.coalesce("text", F.lit(""))
    packed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h1") == F.col("t1")) & (F.col("h2") == F.col("t2"))
    kept = packed.join(heads, same, "left_semi")
    repeated = found.where("n_shingles > 0").groupBy("doc_id", "t1", "t2").count().where("count > 1").limit(1).count()
    if repeated:  # equal rows under one id
        blank = F.length(F.trim(F.coalesce("row.text", F.lit("")), F.lit(BLANKS))) == 0
        kept = kept.withColumn("own", F.when(blank, F.monotonically_increasing_id()).otherwise(-1)).dropDuplicates(["id", "h1", "h2", "own"])
    return kept.select("row.*")
