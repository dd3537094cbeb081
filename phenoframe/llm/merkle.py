"""Merkle manifest of documents: levels as linked rows, proofs by a recursive climb.

A leaf is the SHA-256 of a document's fields.  The leaves of a language, in
the order of their ids, make a tree of runs of eight; the languages'
subroots, in order, make the tree above them.

1. Leaves get their places by ``running`` sums over ranges of (language, id),
   so a language of any size is ranked by many tasks.
2. Every level is built by grouping the one below into runs of at most eight
   nodes.  A run's row holds its nodes' digests and is linked to the run
   that holds its own digest; the rows of all levels are stored as one table.
3. A recursive query climbs: from every run of leaves, one step joins the
   run above, appends its siblings and folds each leaf's digest (the tampered
   one where the document was tampered with) with them, until there is no
   run above.  Leaves of a run share all siblings above it, so they climb in
   one row.  Runs near the top meet many climbers: their rows are repeated
   under salts, more of them the higher they are, and climbers spread over them.

Defined results: ids are ordered by their own type, NULL first, equal ids by
their leaves; repeated rows are leaves of their own; a NULL id is never
tampered with; an empty table has no rows.  Other columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenoframe.llm.running import running
from phenoframe.llm.stages import Scratch, small
from phenoframe.llm.text import ascii_lower

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many is tampered with.
TAMPER = 3
#: Copies of a run's row at the second level above the leaves' runs and up: each level has eight times more, up to the last.
MOST_COPIES = 4096
#: Name of the tree over the subroots; a language's tree is named by the language behind "=", that of NULL is "-".
TOP, NO_LANG = "", "-"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of fields, each as its UTF-8 byte count, a colon and its text, or a dash for NULL."""
    told = [F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*told), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id``, its ``tree``, the ``leaf`` digest and ``told``, the one of the tampered text."""
    def of(text: Column) -> Column:
        return digest_of(*(F.col(c).cast("string") for c in FIELDS if c != "text"), text)

    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))
    leaf = of(F.col("text"))
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(NO_LANG)).alias("tree"), leaf.alias("leaf"),
                       F.when(tampered, of(ascii_lower(F.col("text")))).otherwise(leaf).alias("told"))


def hexes(digests: str) -> str:
    return f"array_join(transform({digests}, d -> lower(hex(d))), '')"


def run_digest(digests: str) -> Column:
    return F.expr(f"unhex(sha2({hexes(digests)}, 256))")


def in_runs(nodes: DataFrame, *columns: str) -> DataFrame:
    """Nodes ``tree, n, place, digest`` in runs: arrays of digests (and of the columns), in order of place."""
    taken = F.array_sort(F.collect_list(F.struct("place", "digest", *columns)))
    runs = nodes.groupBy("tree", "n", F.floor(F.col("place") / FANOUT).alias("run")).agg(taken.alias("nodes"))
    return runs.select("tree", "n", "run", F.col("nodes.digest").alias("digests"), *(F.col(f"nodes.{c}").alias(c) for c in columns))


def raised(runs: DataFrame, level: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The levels above runs of the lowest one, and each tree's root (``tree``, ``digest``)."""
    levels, roots = [runs.select("tree", "n", "run", "digests").withColumn("level", F.lit(level))], []
    below = runs.select("tree", "n", "run", F.when(F.col("n") > 1, run_digest("digests")).otherwise(F.element_at("digests", 1)).alias("digest"))
    width = FANOUT
    most = runs.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(below.where(F.col("n") <= width).select("tree", "digest"))
        if most <= width:
            break
        level += 1
        nodes = below.where(F.col("n") > width).select("tree", "n", F.col("run").alias("place"), "digest")
        above = scratch.keep(in_runs(nodes).withColumn("level", F.lit(level)), "level")
        levels.append(above)
        below = above.select("tree", "n", "run", run_digest("digests").alias("digest"))
        width *= FANOUT
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    return levels, every


def linked(runs: DataFrame, tops: DataFrame, *columns: str) -> DataFrame:
    """Runs with the place of their digest in the run above: ``up_tree, up_level, up_run, up_place`` (NULL at the root).

    ``tops`` has the place of each language's subroot in the top tree, and the number of subroots."""
    width = F.pow(F.lit(float(FANOUT)), F.col("level") + 1)
    inside = F.col("n") > width
    above = (F.col("tree") != TOP) & (F.col("subroots") > 1)
    place = F.when(inside, F.col("run")).when(above, F.col("top_place"))
    return runs.join(tops, "tree", "left").select(
        "tree", "level", "run", "digests", *columns,
        F.when(inside, F.col("tree")).when(above, F.lit(TOP)).alias("up_tree"),
        F.when(inside, F.col("level") + 1).when(above, F.lit(0)).cast("int").alias("up_level"),
        F.floor(place / FANOUT).alias("up_run"), (place % FANOUT).cast("int").alias("up_place"))


def copies(tree: Column, level: Column) -> Column:
    """Copies of the row of a run, so that climbers of a hot run spread over them."""
    by_level = F.when(level <= 1, 1).otherwise(F.least(F.pow(F.lit(float(FANOUT)), level - 1), F.lit(MOST_COPIES)))
    return F.when(tree == TOP, MOST_COPIES).otherwise(by_level).cast("long")


#: Sixty levels of eight are beyond any table.  One row climbs for all leaves of a run: ``tree`` and ``run`` name it, ``folded`` has a digest a leaf, ``path`` the siblings so far.
CLIMB = """
WITH RECURSIVE climb(tree, run, folded, path, up_tree, up_level, up_run, up_place, salt) MAX RECURSION LEVEL 60 AS (
    SELECT tree, run, folded, path, up_tree, up_level, up_run, up_place, salt FROM {starts}
    UNION ALL
    SELECT c.tree, c.run,
        transform(c.folded, f -> unhex(sha2(concat(left(a.hexes, 64 * c.up_place), lower(hex(f)), substr(a.hexes, 64 * c.up_place + 65)), 256))),
        c.path || unhex(concat(left(a.hexes, 64 * c.up_place), substr(a.hexes, 64 * c.up_place + 65))),
        a.up_tree, a.up_level, a.up_run, a.up_place, pmod(c.run, a.up_copies)
    FROM climb c JOIN {above} a ON c.up_tree = a.tree AND c.up_level = a.level AND c.up_run = a.run AND c.salt = a.salt
)
SELECT tree, run, folded, path FROM climb WHERE up_run IS NULL"""


@contextmanager
def any_number_of_rows(spark):
    """Recursive queries end at a row limit that the session sets; the climb's rows are bounded by the table's."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, digests in hex."""
    scratch = Scratch(docs)
    spark = docs.sparkSession
    leaf_rows = scratch.keep(leaves(docs), "leaves")
    placed = running(leaf_rows, "tree", ["doc_id", "leaf", "told"], scratch).withColumnRenamed("run_place", "place")
    numbers = leaf_rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    nodes = placed.withColumnRenamed("leaf", "digest").join(small(scratch.keep(numbers, "numbers")), "tree")
    base = scratch.keep(in_runs(nodes, "doc_id", "told"), "runs")
    levels, subroots = raised(base, 0, scratch)
    subroots = scratch.keep(subroots, "subroots")
    # NULL's tree first ("-" sorts before "="), the others by the language's bytes.
    ordered = running(subroots.withColumn("all", F.lit(0)), "all", ["tree"], scratch).drop("all")
    count = subroots.count()
    tops = small(scratch.keep(ordered.select("tree", F.col("digest").alias("subroot"), F.col("run_place").alias("top_place"),
                                             F.lit(count).cast("long").alias("subroots")), "tops"))
    top_nodes = tops.select(F.lit(TOP).alias("tree"), F.col("subroots").alias("n"), F.col("top_place").alias("place"), F.col("subroot").alias("digest"))
    top_levels, root = raised(scratch.keep(in_runs(top_nodes), "top"), 0, scratch)
    root = [bytes(r.digest) for r in root.collect()]  # one digest, none of an empty table
    every = levels[1:] + (top_levels if count > 1 else [])
    above = linked(levels[0].limit(0), tops)
    for level in every:
        above = above.unionByName(linked(level, tops))
    above = above.select("*", F.expr(hexes("digests")).alias("hexes"), copies(F.col("up_tree"), F.col("up_level")).alias("up_copies")).drop("digests")
    above = scratch.keep(above.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("tree"), F.col("level")) - 1))), "above")
    # The first step needs no join: a run of leaves has its siblings in its own row.
    folded = F.expr(f"""transform(told, (t, i) -> IF(n = 1, t, unhex(sha2(concat(
        {hexes("slice(digests, 1, i)")}, lower(hex(t)), {hexes(f"slice(digests, i + 2, {FANOUT})")}), 256))))""")
    starts = linked(base.select("*", F.lit(0).alias("level"), folded.alias("folded")), tops, "folded")
    starts = scratch.keep(starts.select("tree", "run", "folded", F.unhex(F.lit("")).alias("path"), "up_tree", "up_level", "up_run", "up_place",
                                        F.pmod("run", copies(F.col("up_tree"), F.col("up_level"))).alias("salt")), "starts")
    with any_number_of_rows(spark):
        climbed = scratch.keep(spark.sql(CLIMB, starts=starts, above=above), "climbed")
    # A leaf's siblings are the others of its run, then those of the path.
    met = base.join(climbed, ["tree", "run"]).join(tops.select("tree", "subroot"), "tree")
    each = met.select("subroot", "digests", "path", F.posexplode(F.arrays_zip("doc_id", "digests", "folded")).alias("i", "own"))
    siblings = F.concat(F.expr(hexes("filter(digests, (d, j) -> j != i)")), F.lower(F.hex("path")))
    text = lambda c: F.lower(F.hex(c))
    root = text(F.lit(root[0] if root else b""))
    result = each.select(F.col("own.doc_id").alias("doc_id"), text("own.digests").alias("leaf"), text("subroot").alias("subroot"), root.alias("root"),
                         F.sha2(siblings, 256).alias("proof_sha256"), text("own.folded").alias("folded_root"))
    return scratch.finish(result.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
