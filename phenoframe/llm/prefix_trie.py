"""Prefix trie of conversations: a z-fast trie built in batches by joins.

A conversation is a string of turns; equal prefixes of conversations are the
nodes of a trie.  A prefix is named by its depth and two 64-bit exclusive
ors of its turns' hashes, each hashed with its depth, so running totals
(see ``running``) give every prefix of every conversation without gathering
a conversation in one task.

1. Conversations are rebuilt (see ``rebuilt``); equal ones are one string
   from here on.
2. The compacted trie keeps a row for each prefix where strings branch or
   end: its depth ``hi`` and hashes, the depth ``lo`` of the one above it,
   and two names of its edge by which strings find it: the prefix one turn
   below ``lo``, and its *handle*, the prefix at the two-fattest depth of
   (lo, hi], the one that most powers of two divide.
3. Strings go in by batches, each about three times what is already there.
   A batch locates its strings by fat binary search: a string that may still
   match between depths (a, b] probes the handles by its prefix at the
   two-fattest depth there; a hit moves a to the found node's depth, a miss
   moves b below the probe.  After as many rounds as the longest string's
   length has bits, a is where the string leaves the trie: the edge below,
   if any, is its exit edge.
4. What lies below those points, together with the exit edges, is the part
   that changes: prefixes there at which strings branch or end become nodes.
   All other rows stay.
5. Counts are taken on the compacted nodes, then edges are expanded to one
   row per prefix.

Defined results: turns are ordered by ``turn``, NULL first, equal ones by
hashes of role and text; a NULL role or text is empty; rows without a
``conv_id`` belong to no conversation; an empty table has no trie, any other
has at least the root.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.running import join_hot, running
from phenoframe.llm.stages import Scratch

#: Conversations come in families of so many, which share the beginning of the first one: up to this many turns less one.
FAMILY, SHARED = 5, 9
#: Shares of the strings (in sixteenths) that are in the trie after each batch.
BATCHES = (1, 4, 16)
#: Depths of an edge that one row expands to at once, and ids that one chunk holds at most.
BLOCK, CHUNK_IDS = 1024, 1 << 16

NODES = "hi long, x long, y long, lo long, px long, py long, nx long, ny long, f long, fx long, fy long, s long"


def turns(conversations: DataFrame) -> DataFrame:
    """``conv, turn``, two hashes of role and text, and the text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(own: DataFrame, convs: DataFrame, total: int) -> DataFrame:
    """Turns of the rebuilt conversations: ``conv, depth, bytes`` and the turn's hashes at its depth.

    ``own`` has the original ``place`` of each turn; ``convs`` says for each
    conversation whose turns (``base``) stand for its first ``h``, and that there are ``kept`` such.
    """
    first = own.where((F.col("conv") % FAMILY == 0) & (F.col("place") < SHARED - 1)).withColumnRenamed("conv", "base")
    first = first.join(convs.select("conv", "base", "h"), "base").where("place < h").select("conv", (F.col("place") + 1).alias("depth"), "h1", "h2", "bytes")
    rest = join_hot(own, convs.select("conv", "h", "kept", "n"), ["conv"], "n", total).where("place >= h")
    rest = rest.select("conv", (F.col("kept") + F.col("place") - F.col("h") + 1).alias("depth"), "h1", "h2", "bytes")
    return first.unionByName(rest).select("conv", "depth", "bytes", F.xxhash64("depth", "h1").alias("z1"), F.xxhash64(F.lit(1), "depth", "h2").alias("z2"))


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the highest power of two divides; a < b."""
    bits = F.floor(F.log2((a.bitwiseXOR(b)).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", b, bits), bits)


def at_depth(rows: DataFrame, prefixes: DataFrame, depth: str, x: str, y: str, how: str = "left") -> DataFrame:
    """``rows`` with the hashes of string ``s``'s prefix at the depth in a column."""
    return rows.join(prefixes.select("s", F.col("depth").alias(depth), F.col("x").alias(x), F.col("y").alias(y)), ["s", depth], how)


def locate(batch: DataFrame, prefixes: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Where each string (``s, len``) leaves the trie: the depth ``p`` of the last node it passes, and its exit edge ``ehi, ex, ey, es`` if there is one."""
    zero = F.lit(0).cast("long")
    state = batch.select("s", "len", zero.alias("a"), F.col("len").alias("b"), zero.alias("above"), zero.alias("tx"), zero.alias("ty"))
    handles = nodes.select("f", F.col("fx").alias("qx"), F.col("fy").alias("qy"), "hi", "lo", F.col("x").alias("ex"), F.col("y").alias("ey"))
    for _ in range(longest.bit_length()):
        # A string that is done probes nothing: its keys are its own, so that such rows do not meet in one task.
        probe = state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest(F.col("a"), F.col("b"))).otherwise(zero))
        probe = at_depth(probe, prefixes, "f", "qx", "qy").withColumns({"qx": F.coalesce("qx", "s"), "qy": F.coalesce("qy", zero)})
        met = probe.join(handles, ["f", "qx", "qy"], "left")
        hit, open_ = F.col("hi").isNotNull(), F.col("f") > 0
        state = met.select(
            "s", "len", F.coalesce("hi", "a").alias("a"), F.when(~hit & open_, F.col("f") - 1).otherwise(F.col("b")).alias("b"),
            F.coalesce("lo", "above").alias("above"), F.coalesce("ex", "tx").alias("tx"), F.coalesce("ey", "ty").alias("ty"))
    # A handle says nothing of the rest of its edge: the string may leave inside the edge it found last.
    state = at_depth(state, prefixes, "a", "qx", "qy")
    passed = (F.col("a") == 0) | F.coalesce((F.col("qx") == F.col("tx")) & (F.col("qy") == F.col("ty")), F.lit(False))
    left = state.select("s", "len", F.when(passed, F.col("a")).otherwise(F.col("above")).alias("p")).withColumn("next", F.col("p") + 1)
    named = at_depth(left, prefixes, "next", "nx", "ny").withColumns({"nx": F.coalesce("nx", "s"), "ny": F.coalesce("ny", zero)})
    edges = nodes.select(F.col("lo").alias("p"), "nx", "ny", F.col("hi").alias("ehi"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("s").alias("es"))
    return named.join(edges, ["p", "nx", "ny"], "left").select("s", "len", "p", "ehi", "ex", "ey", "es")


def along(edges: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Rows of ``prefixes`` for each depth in (lo, hi] of edges of string ``s``, with the edges' columns."""
    blocks = edges.withColumn("from", F.explode(F.sequence(F.col("lo") + 1, F.col("hi"), F.lit(BLOCK).cast("long"))))
    each = blocks.withColumn("depth", F.explode(F.sequence("from", F.least(F.col("from") + BLOCK - 1, "hi")))).drop("from")
    return each.join(prefixes, ["s", "depth"])


def insert(found: DataFrame, prefixes: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie with the strings of a batch, of which ``locate`` found where they leave it."""
    columns = ["s", "p", "depth", "x", "y", "px", "py", "fixed"]
    total = prefixes.count()
    new = join_hot(prefixes.drop("len"), found.select("s", "len", "p"), ["s"], "len", total).where("depth > p").withColumn("fixed", F.col("depth") == F.col("len"))
    edges = found.where("es is not null").select(F.col("es").alias("s"), F.col("p").alias("lo"), F.col("ehi").alias("hi"), "ex", "ey").distinct()
    edges = scratch.keep(edges, "edges")
    old = along(edges.drop("ex", "ey"), prefixes).withColumn("fixed", F.col("depth") == F.col("hi")).withColumnRenamed("lo", "p")
    region = scratch.keep(new.select(*columns).unionByName(old.select(*columns)), "region")
    every = region.groupBy("depth", "x", "y").agg(F.min("s").alias("rep"), F.max("fixed").alias("fixed"), F.count(F.lit(1)).alias("many"))
    below = region.select("depth", "x", "y", "px", "py").distinct().groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
    below = below.agg(F.count(F.lit(1)).alias("ways"))
    explicit = every.join(below, ["depth", "x", "y"], "left").where("fixed or ways > 1").select("depth", "x", "y", "rep", "many")
    explicit = scratch.keep(explicit, "explicit")
    on_path = join_hot(region, explicit, ["depth", "x", "y"], "many", region.count())
    # The depths where a string now meets nodes, of which each one's predecessor is where its edge begins.
    on_path = scratch.keep(on_path.select("s", "p", "depth", "x", "y", "rep"), "on-path")
    lag = F.expr("lag(depth) OVER (PARTITION BY s, p ORDER BY depth)")
    made = on_path.withColumn("lo", F.coalesce(lag, "p")).where("s = rep").select("s", F.col("depth").alias("hi"), "x", "y", "lo")
    made = made.withColumns({"next": F.col("lo") + 1, "f": fattest(F.col("lo"), F.col("hi"))})
    made = made.join(prefixes.select("s", F.col("depth").alias("next"), F.col("x").alias("nx"), F.col("y").alias("ny"), "px", "py"), ["s", "next"])
    made = at_depth(made, prefixes, "f", "fx", "fy", "inner").drop("next")
    kept = nodes.join(edges.select("hi", F.col("ex").alias("x"), F.col("ey").alias("y")), ["hi", "x", "y"], "left_anti")
    return scratch.keep(kept.unionByName(made.select(*nodes.columns)), "trie")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step of ``mapInArrow`` over chunks of ids sorted by key and chunk: SHA-256 of each key's ids, one chunk in memory at a time."""
    key, sha = None, None

    def told():
        return pa.RecordBatch.from_pydict({"hi": pa.array([key[0]], pa.int64()), "x": pa.array([key[1]], pa.int64()), "y": pa.array([key[2]], pa.int64()),
                                           "ends_sha256": pa.array([sha.hexdigest()])})

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["hi"], row["x"], row["y"])
            if at != key:
                if key is not None:
                    yield told()
                key, sha = at, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(row["ids"].encode())
    if key is not None:
        yield told()


def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids that end at each key ``hi, x, y``.

    Chunks of ids are sorted and joined by many tasks; only the hashing of a
    key's chunks, which SHA-256 itself wants in order, is one task's work."""
    chunks = ends.groupBy("hi", "x", "y", F.floor(F.col("conv") / CHUNK_IDS).alias("chunk")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    chunks = chunks.select("hi", "x", "y", "chunk", F.expr("array_join(transform(ids, i -> string(i)), ',')").alias("ids"))
    placed = chunks.repartition("hi", "x", "y").sortWithinPartitions("hi", "x", "y", "chunk")
    return placed.mapInArrow(digests, "hi long, x long, y long, ends_sha256 string")


def trie(prefixes: DataFrame, strings: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """Compacted nodes of the strings (``s, len``), inserted in batches."""
    nodes = scratch.spark.createDataFrame([], NODES)
    before = 0
    for upto in BATCHES if longest else ():
        share = F.pmod(F.xxhash64("s"), F.lit(BATCHES[-1]))
        batch = strings.where((share >= before) & (share < upto)).select("s", "len")
        found = scratch.keep(locate(batch, prefixes, nodes, longest if before else 0), "found")
        nodes = insert(found, prefixes, nodes, scratch)
        before = upto
    return nodes


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    scratch = Scratch(conversations)
    key = ["hi", "x", "y"]
    zero = F.lit(0).cast("long")
    rows = scratch.keep(turns(conversations), "turns")
    own = scratch.keep(running(rows, "conv", ["turn", "h1", "h2"], scratch).withColumnRenamed("run_place", "place"), "own")
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED, "base": F.col("conv") - F.col("conv") % FAMILY})
    convs = scratch.keep(convs, "convs")
    convs = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    convs = scratch.keep(convs.withColumn("kept", F.least("h", F.coalesce("n_base", zero))).withColumn(
        "len", F.col("kept") + F.greatest(F.col("n") - F.col("h"), zero)), "rebuilding")
    said = scratch.keep(rebuilt(own, convs, own.count()), "rebuilt")
    summed = running(said, "conv", ["depth"], scratch, ["bytes"], ["z1", "z2"])
    summed = scratch.keep(summed.select("conv", "depth", F.col("run_z1").alias("x"), F.col("run_z2").alias("y"), F.col("run_z1").bitwiseXOR(F.col("z1")).alias("px"),
                                        F.col("run_z2").bitwiseXOR(F.col("z2")).alias("py"), "bytes", F.col("run_bytes").alias("upto")), "prefixes")
    last = convs.select("conv", F.col("len").alias("hi")).join(summed.select("conv", F.col("depth").alias("hi"), "x", "y"), ["conv", "hi"], "left")
    ends = scratch.keep(last.select("conv", "hi", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y")), "ends")
    strings = ends.where("hi > 0").groupBy(*key).agg(F.min("conv").alias("s"), F.count(F.lit(1)).alias("n_ends"))
    strings = scratch.keep(strings.withColumnRenamed("hi", "len"), "strings")
    prefixes = join_hot(summed.withColumnRenamed("conv", "s"), strings.select("s", "len", "n_ends"), ["s"], "len", summed.count())
    prefixes = scratch.keep(prefixes, "strings-prefixes")
    longest = strings.agg(F.max("len")).first()[0] or 0
    nodes = trie(prefixes, strings, longest, scratch)

    # Members of the compacted nodes, and what each edge saves.
    paths = scratch.keep(prefixes.select("s", F.col("depth").alias("hi"), "x", "y", "n_ends").join(nodes.select(*key), key), "paths")
    members = paths.groupBy(*key).agg(F.sum("n_ends").alias("n_convs"), F.min("s").alias("first"))
    ways = nodes.groupBy(F.col("lo").alias("hi"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("ways"))
    known = nodes.drop("s", "nx", "ny", "f", "fx", "fy").join(members, key).join(ways, key, "left").withColumn("ways", F.coalesce("ways", zero))
    known = known.withColumnRenamed("first", "s").withColumn("depth", F.col("lo") + 1)
    known = known.join(prefixes.select("s", "depth", (F.col("upto") - F.col("bytes")).alias("upto_lo")), ["s", "depth"]).drop("depth")
    known = known.join(prefixes.select("s", F.col("depth").alias("hi"), F.col("upto").alias("upto_hi"), F.col("bytes").alias("bytes_hi")), ["s", "hi"])
    known = scratch.keep(known.withColumn("value", (F.col("n_convs") - 1) * (F.col("upto_hi") - F.col("upto_lo"))), "known")
    # A node is counted to its smallest member, which has then all nodes below it on its path.  So below a node lies all that
    # the other strings through it have, and of its own string what comes after it.
    saved = scratch.keep(running(known, "s", ["hi"], scratch, ["value"]), "saved")
    own_value = known.groupBy("s").agg(F.sum("value").alias("total"))
    leaf = strings.withColumnRenamed("len", "hi").join(known.where("ways = 0").select(*key), key, "left_semi").select("s", F.lit(1).cast("long").alias("leaf"))
    facts = strings.select("s").join(own_value, "s", "left").join(leaf, "s", "left")
    below = paths.join(facts, "s").groupBy(*key).agg(F.sum(F.coalesce("total", zero)).alias("total"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))
    full = saved.join(below, key).withColumn("saved", F.col("total") - F.col("run_value") + (F.col("n_convs") - 1) * F.col("bytes_hi"))
    full = scratch.keep(full.select("s", *key, "lo", "px", "py", "n_convs", "ways", "n_leaves", "saved", "upto_hi", "bytes_hi"), "full")
    least, n_all = ends.agg(F.min("conv"), F.count(F.lit(1))).first()
    parents = full.where("ways > 0").select(F.col("hi").alias("lo"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("s").alias("parent"), F.col("ways").alias("of"))
    inner = join_hot(full.where("lo > 0"), parents, ["lo", "px", "py"], "of", full.count()).drop("of")
    full = inner.unionByName(full.where("lo = 0").withColumn("parent", F.lit(least).cast("long")))
    # Edges in full: a row for each prefix.
    each = along(full.drop("x", "y", "px", "py"), prefixes.select("s", "depth", "x", "y", "bytes", "upto"))
    at_node = F.col("depth") == F.col("hi")
    inside = (F.col("n_convs") - 1) * (F.col("upto_hi") - F.col("bytes_hi") - F.col("upto") + F.col("bytes"))
    each = each.select(
        F.col("s").alias("conv_id"), F.col("depth"), F.when(F.col("depth") == F.col("lo") + 1, F.col("parent")).otherwise(F.col("s")).alias("parent_conv_id"),
        "n_convs", F.when(at_node, F.col("ways")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("saved") + F.when(at_node, 0).otherwise(inside)).alias("saved_tokens"), "x", "y")
    root = known.agg(F.coalesce(F.sum("value"), zero).alias("saved_tokens"), F.sum(F.when(F.col("lo") == 0, 1).otherwise(0)).alias("ways"),
                     F.sum(F.when(F.col("ways") == 0, 1).otherwise(0)).alias("leaves"))
    root = root.where(F.lit(n_all > 0)).select(
        F.lit(least).cast("long").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_all).cast("long").alias("n_convs"),
        F.coalesce("ways", zero).alias("n_children"), F.greatest(F.coalesce("leaves", zero), F.lit(1)).alias("n_leaves"), "saved_tokens", zero.alias("x"), zero.alias("y"))
    told = each.unionByName(root).join(end_digests(ends).withColumnRenamed("hi", "depth"), ["depth", "x", "y"], "left")
    nothing = hashlib.sha256().hexdigest()
    result = told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(nothing))).drop("x", "y")
    return scratch.finish(result.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")
