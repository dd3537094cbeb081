"""Weighted rendezvous hashing of record keys over shards.

Every (key, shard) pair has a pseudo-random draw ``u`` in (0, 1) from the
MD5 of the key and the shard number; the record goes to the shard with the
smallest ``-ln(u) / weight``.  A shard's draws do not depend on the other
shards, so adding a shard only moves the records that the new shard wins,
and removing one only moves its own.

Defined results: a NULL key hashes like the empty text; repeated keys share
a shard; an empty table gives an empty result; NULL text has size 1 and the
checksum of the empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from phenoframe.llm.text import own

N_SHARDS = 16
#: Rows that one ordering task should hold.
ROWS_PER_BLOCK = 100_000
# Fixed value: 13 hexadecimal digits, the most that a double holds exactly.
DRAW_DIGITS, DRAW_RANGE = 13, float(16 ** 13)


def draw(key: Column, salt: str) -> Column:
    """Uniform number in (0, 1) from a text key and a salt."""
    digits = F.substring(F.md5(F.concat(key, F.lit(salt))), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(DRAW_RANGE)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number of a text key among ``len(weights)`` shards."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    costs = [F.struct((-F.ln(draw(key, f":{i}")) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
             for i, w in enumerate(weights)]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def assign_shards(df: DataFrame, key: str = "doc_id", weights: Sequence[float] = (1.0,) * N_SHARDS,
                  into: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(into, rendezvous(key_text(F.col(key)), weights))


def number_rows(df: DataFrame, shard: str, key: str, ties: Sequence[str], into: str = "slot",
                rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``df`` with gapless numbers from 0 within each shard, in the order of MD5(key), key, ties.

    Equal rows are counted before the shuffle and expanded at the end.  The
    order is cut into blocks by the leading MD5 digits, so that no task
    orders a whole shard: positions within a block are added to the running
    total of the blocks before it.
    """
    names = list(df.columns)
    total, block, digest, at, before, ends = (own(df, x) for x in ("total", "block", "digest", "at", "before", "ends"))
    n_blocks = max(1, df.count() // rows_per_block)
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias(total))
    placed = (counted.withColumn(digest, F.md5(key_text(F.col(key))))
              .withColumn(block, F.floor(draw(key_text(F.col(key)), "") * n_blocks)))
    inside = Window.partitionBy(shard, block).orderBy(digest, F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in ties])
    placed = placed.withColumn(ends, F.sum(total).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = placed.groupBy(shard, block).agg(F.max(ends).alias(at))
    earlier = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(shard, block, F.coalesce(F.sum(at).over(earlier), F.lit(0)).alias(before))
    first = F.col(before) + F.col(ends) - F.col(total)
    return (placed.join(sizes, [shard, block])
            .select(*names, F.explode(F.sequence(first, first + F.col(total) - 1)).alias(into)))


def shard_plan(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: shard, slot, size and checksum, and the shard with one shard more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = assign_shards(rows, weights=(1.0,) * n_shards)
    rows = number_rows(rows, "shard", "doc_id", ["size", "text_crc32"])
    rows = assign_shards(rows, weights=(1.0,) * (n_shards + 1), into="grown_shard")
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
