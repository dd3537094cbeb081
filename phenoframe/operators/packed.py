"""Records packed into longs, so that choosing one per patient is a hash aggregation.

A category code of up to five ASCII characters takes 35 bits.  A dated
record is one long, ordered by day, then source, then code: the greatest is
the best record, and the best is unclear when the least code among the best
records differs.  Votes are bits: each category has one for each source, so
``bit_or`` counts every source once, and a patient's vector is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE_CHARS, CHAR_BITS, PRIORITY_BITS = 5, 7, 3
CODE_BITS = CODE_CHARS * CHAR_BITS
#: Sources that a category's votes tell apart, and categories of one long.
SOURCES = 5
SLOTS = 60 // SOURCES


def shl(c: Column, n) -> Column:
    return F.call_function("shiftleft", c, n if isinstance(n, Column) else F.lit(n))


def shr(c: Column, n) -> Column:
    return F.call_function("shiftright", c, n if isinstance(n, Column) else F.lit(n))


def low_bits(c: Column, n: int) -> Column:
    return c.bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def pack_code(code: Column) -> Column:
    """A code of 1 to 5 ASCII characters as a long; NULL stays NULL, any other code fails the job."""
    chars = [shl(F.ascii(F.substring(code, i + 1, 1)).cast("long"), CHAR_BITS * (CODE_CHARS - 1 - i)) for i in range(CODE_CHARS)]
    fits = (F.octet_length(code) <= CODE_CHARS) & (F.octet_length(code) == F.length(code))
    wrong = F.raise_error(F.concat(F.lit("category codes must have at most five ASCII characters (else pass long_codes=True): "), code)).cast("long")
    return F.when(code.isNull(), F.lit(None).cast("long")).when(fits, reduce(lambda a, b: a.bitwiseOR(b), chars)).otherwise(wrong)


def unpack_code(packed: Column) -> Column:
    chars = [low_bits(shr(packed, CHAR_BITS * (CODE_CHARS - 1 - i)), CHAR_BITS) for i in range(CODE_CHARS)]
    return F.concat(*[F.when(c > 0, F.call_function("chr", c)).otherwise("") for c in chars])


def pack_record(date: Column, priority: int, code: Column) -> tuple[Column, Column]:
    """A dated record as a long that is greatest for the best one, and as one that is least for the best one."""
    day, packed = F.unix_date(date).cast("long"), pack_code(code)
    top = (1 << PRIORITY_BITS) - 1
    return shl(day * (top + 1) + F.lit(top - priority), CODE_BITS) + packed, shl(-day * (top + 1) + F.lit(priority), CODE_BITS) + packed


def code_of(packed: Column) -> Column:
    return low_bits(packed, CODE_BITS)


def day_of(best: Column) -> Column:
    return F.date_from_unix_date(shr(best, CODE_BITS + PRIORITY_BITS).cast("int"))


def priority_of(best: Column) -> Column:
    return F.lit((1 << PRIORITY_BITS) - 1) - low_bits(shr(best, CODE_BITS), PRIORITY_BITS)


def n_words(categories: list[str]) -> int:
    return -(-len(categories) // SLOTS)


def slot_of(code: Column, categories: list[str]) -> Column:
    """Place of a code among the categories, -1 for another one, NULL for NULL."""
    known = reduce(lambda e, i: e.when(code == categories[i], i), range(len(categories)), F)
    return known.when(code.isNotNull(), -1)


def vote(code: Column, source: int, categories: list[str], slot: Column | None = None) -> dict[str, Column]:
    """Columns of one vote of a ``source`` (its bit's number): a long for each ``SLOTS`` of the categories, and for a code
    that is none of them the source's bit and the packed code.  All NULL for a NULL code.  ``slot``: a column with ``slot_of`` the code."""
    slot = slot_of(code, categories) if slot is None else slot
    one = 1 << source

    def word(w: int) -> Column:
        own = (slot >= w * SLOTS) & (slot < (w + 1) * SLOTS)
        return F.when(own, shl(F.lit(one).cast("long"), (slot - w * SLOTS) * SOURCES))

    other = F.when(slot < 0, pack_code(code))
    return {f"_v{w}": word(w) for w in range(n_words(categories))} | {"_rest": F.when(slot < 0, F.lit(one)), "_first": other, "_last": other}


def both_votes(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Columns for two votes in one row."""
    def either(x: Column, y: Column) -> Column:
        return F.when(x.isNull(), y).when(y.isNull(), x).otherwise(x.bitwiseOR(y))

    return {n: F.least(a[n], b[n]) if n == "_first" else F.greatest(a[n], b[n]) if n == "_last" else either(a[n], b[n]) for n in a}


def gathered(categories: list[str]) -> list[Column]:
    """Aggregates of vote columns."""
    names = [f"_v{w}" for w in range(n_words(categories))]
    return [*(F.bit_or(n).alias(n) for n in names), F.bit_or("_rest").alias("_rest"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]


def unique_winner(categories: list[str]) -> tuple[Column, Column]:
    """Of gathered votes: the category with most votes, and whether it is the only one.

    One code outside ``categories`` is counted like them; a patient with two
    different such codes fails the job.  The vector is read by one fold over
    its slots, small in generated code however many categories there are."""
    words = F.array(*[F.coalesce(f"_v{w}", F.lit(0).cast("long")) for w in range(n_words(categories))])
    places = F.sequence(F.lit(0), F.lit((SLOTS - 1) * SOURCES), F.lit(SOURCES))
    counts = F.flatten(F.transform(words, lambda w: F.transform(places, lambda at: F.bit_count(low_bits(shr(w, at), SOURCES)))))
    two = F.raise_error(F.concat(F.lit("a patient has two categories that are not listed; pass them in categories: "),
                                 unpack_code(F.col("_first")), F.lit(", "), unpack_code(F.col("_last")))).cast("int")
    rest = F.when(F.col("_first").isNull(), 0).when(F.col("_first") == F.col("_last"), F.bit_count("_rest")).otherwise(two)
    # Votes, place (from 1, the code outside the list last) and whether another has as many, in one number.
    ranked = F.transform(F.concat(counts, F.array(rest)), lambda n, i: n * 2048 + (i + 1) * 2)
    best = F.aggregate(ranked, F.lit(0), lambda top, x: F.when(shr(x, 11) > shr(top, 11), x).when(shr(x, 11) == shr(top, 11), top.bitwiseOR(F.lit(1))).otherwise(top))
    place = low_bits(shr(best, 1).cast("long"), 10).cast("int")
    listed = F.element_at(F.array(*map(F.lit, categories), *[F.lit(None).cast("string")] * (n_words(categories) * SLOTS - len(categories) + 1)), place)
    return F.coalesce(listed, unpack_code(F.col("_first"))), (shr(best, 11) > 0) & (low_bits(best.cast("long"), 1) == 0)
