"""Bottom-k sketches of word shingles.

The sketch of a text is the sorted array of its ``K`` smallest distinct
64-bit shingle hashes (all of them when there are fewer).  Sketches of parts
merge into the sketch of the union, and two sketches estimate how alike
their texts are, how much of one the other holds, and how many distinct
shingles there are.

A shingle is five words in a row; a text of one to four words is one shingle.

Defined results: NULL and blank texts have the empty sketch; two empty
sketches are alike (1.0), an empty and a full one are not (0.0); equal texts
have equal sketches; in a table of one document it is its own next document;
documents with equal ids are taken in the order of their texts, those
without an id come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenoframe.llm.text import words

SHINGLE_WORDS = 5
K = 128
#: Documents that one task puts in order.
ROWS_PER_BLOCK = 4_000
# Fixed value: the number of 64-bit hashes, and the least of them.
HASHES, LEAST = float(2 ** 64), -2 ** 63


def shingle_hashes(w: Column) -> Column:
    """Hashes of the shingles of an array of words."""
    last = F.size(w) - SHINGLE_WORDS
    rows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE_WORDS)]))
    return F.when(last >= 0, rows).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def bottom_k(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two texts' shingles."""
    return bottom_k(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of all shingles of the two that both have."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below ``k``."""
    reach = (F.get(a, F.lit(k - 1)).cast("double") - F.lit(float(LEAST))) / F.lit(HASHES)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_sketch(df: DataFrame, text: str, into: str, k: int = K) -> DataFrame:
    """``df`` with the sketch of a text column."""
    w, h = f"__{into}_words", f"__{into}_hashes"
    return (df.withColumn(w, words(F.col(text))).withColumn(h, shingle_hashes(F.col(w)))
            .withColumn(into, bottom_k(F.col(h), k)).drop(w, h))


def block_of(key: Column, lows: list[int]) -> Column:
    """Number of the block of a key, for blocks in falling order given by their lowest keys.

    Binary search by halving steps over a literal array.
    """
    array = F.split(F.lit(",".join(map(str, lows))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(lows).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) > key, at + step).otherwise(at))


def with_next(docs: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``doc_id``, ``text`` and sketch of each document with those of the next one by falling id.

    Only the keys are range-partitioned to find blocks of even size; each
    block is then put in order by one task, and the first document of a block
    is also sent to the block before it.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LEAST)).cast("long").alias("key"))
    n_blocks = max(64, docs.count() // rows_per_block)
    parts = rows.select("key").repartitionByRange(n_blocks, F.col("key").desc()).groupBy(F.spark_partition_id()).agg(
        F.min("key").alias("low"), F.max("key").alias("high")).orderBy(F.col("low").desc()).collect()
    lows, highs = [p["low"] for p in parts], [p["high"] for p in parts]
    if not parts:
        lows, highs = [LEAST], [LEAST]
    block = block_of(F.col("key"), lows)
    rows = rows.withColumn("block", block)
    heads = rows.where(F.col("key").isin(highs)).groupBy("block", "key").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), "text", "key",
                         F.pmod(F.col("block") - 1, F.lit(len(lows))).alias("block"), F.lit(1).alias("guest"))
    order = Window.partitionBy("block").orderBy("guest", F.col("key").desc(), "text")
    both = rows.withColumn("guest", F.lit(0)).select("doc_id", "text", "key", "block", "guest").unionByName(heads)
    both = with_sketch(both.withColumn("next_text", F.lead("text").over(order)), "text", "sketch")
    return both.withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0").drop("key", "block", "guest")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, and their likeness.

    The edited text has its last half of characters replaced by the first as
    many of the next document.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half),
                                              F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
