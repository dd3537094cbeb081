"""Removal of lines whose template recurs across documents, by a log-template tree.

Parsing.  A line is its words; words that hold a digit are variable fields
and become ``<*>``.  The tree has a fixed depth: the first level is the
number of words, the next ``DEPTH`` levels the leading words, and all lines
with the same path share a leaf.

Generalising.  In a leaf, a word is constant at its place when enough
families of documents have it there; all others become ``<*>``.  A line's
family is the least shingle hash of its document outside the line, so that a
long line does not make its documents look alike.  What remains is the
line's template, if at least ``CONSTANT_PERCENT`` of its words are constant.

Recurrence.  A template recurs when its lines are found in at least
``LEAST`` documents of which no two are copies, whatever else holds them: a
group of near copies does not lose its own lines, and cannot keep a line
that unrelated documents hold too.  Two documents are copies when their
shingles (five words in a row) resemble by ``COPY_PERCENT``, or by
``REST_PERCENT`` without those that touch the template's lines, as estimated
from the ``SKETCH`` least shingle hashes of each.  Each task keeps the
documents of a template that are no copies of one kept before, until there
are ``LEAST``; what the tasks kept is then gone through again by template.
Lines of recurring templates are dropped wherever they stand.

All else is a count by key; no leaf is gathered in one task.

Defined results: NULL counts as the empty text; lines without a word are
kept and not counted; repeated rows lose the same lines; a document may lose
all of its lines.  Lines, words and documents are compared by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenoframe.llm import blocks
from phenoframe.llm.stages import cut, small
from phenoframe.llm.text import own

DEPTH = 3
LEAST = 8
CONSTANT_PERCENT = 80
SHINGLE_WORDS = 5
#: Least shingle hashes kept of a document, and the resemblances from which on documents are copies: whole, and without the line.
SKETCH = 64
COPY_PERCENT, REST_PERCENT = 75, 50
MASK = b"<*>"
DIGIT = re.compile(b"[0-9]")
#: Documents taken from a batch at a time, and characters after which no more are.
BATCH_DOCS, BATCH_CHARS = 1_000, 2_000_000
BLANK = " \t\x0b\x0c\r"


def hash_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - 2 ** 63


def line_words(line: str) -> list[str]:
    """Words of a line, variable fields masked."""
    return [w.decode() for w in masked_words(line.encode())]


def masked_words(line: bytes) -> list[bytes]:
    return masked(line, line.split())


def masked(line: bytes, found: list[bytes]) -> list[bytes]:
    return [MASK if DIGIT.search(w) else w for w in found] if DIGIT.search(line) else found


def path_of(words: list[bytes]) -> int:
    return hash_of(b" ".join([b"%d" % len(words), *words[:DEPTH]]))


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64)


def windows(h: np.ndarray) -> np.ndarray:
    """For each word, the hash of the shingle that begins there; of the words left near the end."""
    value = np.zeros(len(h), dtype=np.uint64)
    for i in range(min(SHINGLE_WORDS, len(h))):
        value[:len(h) - i] = blocks.mix(value[:len(h) - i] + h[i:])
    return value


def shingle_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Hash of each shingle of a text, the whole of a shorter one; ``known`` is not used."""
    return text_shingles([word_hashes(text.encode().split())])[0]


def text_shingles(words: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of each shingle of some texts, from those of their words."""
    value, end = windows(np.concatenate(words)), 0
    out = []
    for h in words:
        begin, end = end, end + len(h)
        out.append(value[begin:end - SHINGLE_WORDS + 1] if len(h) >= SHINGLE_WORDS else windows(h)[:1])
    return out


def family_of(text: str, known: dict[bytes, int]) -> int:
    """Least shingle hash of a text."""
    value = shingle_hashes(text, known)
    return int(value.min() >> np.uint64(1)) if len(value) else 0


def families_of(value: np.ndarray, counts: list[int]) -> list[int]:
    """For each line, the least shingle hash of the text among those that do not touch it; where all do, of the whole text."""
    value = value >> np.uint64(1)
    n = len(value)
    edges = np.cumsum([0, *counts])
    before, after = np.empty(n + 1, dtype=np.uint64), np.empty(n + 1, dtype=np.uint64)
    before[0] = after[n] = value.max()
    np.minimum.accumulate(value, out=before[1:])  # least of the first 0, 1, 2, ... shingles
    np.minimum.accumulate(value[::-1], out=after[:n][::-1])
    n_before = np.minimum(np.maximum(edges[:-1] - SHINGLE_WORDS + 1, 0), n)
    from_after = np.minimum(edges[1:], n)
    alone = (n_before == 0) & (from_after == n)
    return np.where(alone, before[n], np.minimum(before[n_before], after[from_after])).tolist()


def least_places(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some places in the order of their hashes, and where each different hash begins among them."""
    at = at[np.argsort(value[at], kind="stable")]
    held = value[at]
    return at, np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))


def sketch_of(value: np.ndarray, counts: list[int]) -> bytes:
    """The least different shingle hashes of a text, each with the last line of its earliest and the first line of its latest place;
    ``counts`` has the words of each line."""
    line = np.repeat(np.arange(len(counts)), counts)
    value = (value >> np.uint64(32)).astype(np.uint32)
    at = None
    if len(value) > 4 * SKETCH:  # most places are above the least hashes, however often those repeat
        at, start = least_places(value, np.flatnonzero(value <= np.partition(value, 4 * SKETCH)[4 * SKETCH]))
    if at is None or len(start) <= SKETCH:
        at, start = least_places(value, np.arange(len(value)))
    value, first, last = value[at], line[at], line[np.minimum(at + SHINGLE_WORDS, len(line)) - 1]
    lists = value[start], np.minimum.reduceat(last, start), np.maximum.reduceat(first, start)
    return np.concatenate([x[:SKETCH].astype(np.uint32) for x in lists]).tobytes()


def read_sketch(sketch: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a document, those whose shingles stand clear of some lines, and the bound up to which they are complete."""
    value, last, first = np.frombuffer(sketch, dtype=np.uint32).reshape(3, -1)
    bound = int(value[-1]) if len(value) == SKETCH else 2 ** 32
    lines = np.sort(np.array(places, dtype=np.uint32))
    touched = np.searchsorted(lines, first) < np.searchsorted(lines, last, "right")  # one place, from its first to its last line
    apart = np.isin(last, lines) & np.isin(first, lines)  # several places
    return value, value[~np.where(first <= last, touched, apart)], bound


def resemble(a: np.ndarray, b: np.ndarray, bound: int, percent: int) -> bool:
    """Whether two sorted lists of hashes resemble so much, up to the bound of both; empty ones tell nothing."""
    a, b = a[:np.searchsorted(a, bound, "right")], b[:np.searchsorted(b, bound, "right")]
    if not len(a) or not len(b):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def copies(a: tuple, b: tuple) -> bool:
    bound = min(a[2], b[2])
    return resemble(a[0], b[0], bound, COPY_PERCENT) or resemble(a[1], b[1], bound, REST_PERCENT)


def unrelated(least: int):
    """Rows of each template in these batches whose documents are no copies of one before; a row without a sketch for a template
    that has ``least`` of them."""

    def run(batches):
        kept: dict[int, list | None] = {}
        rows: dict[int, list] = {}
        for batch in batches:
            for template, sketch, places in zip(*(batch.column(c).to_pylist() for c in ("template", "sketch", "places"))):
                held = kept.setdefault(template, [])
                if held is None:
                    continue
                if sketch is not None:
                    new = read_sketch(sketch, places)
                    if any(copies(new, x) for x in held):
                        continue
                    held.append(new)
                    rows.setdefault(template, []).append((sketch, places))
                if sketch is None or len(held) >= least:
                    kept[template], rows[template] = None, [(None, None)]
        out = [(t, *x) for t, found in rows.items() for x in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.int32())))],
                                             names=["template", "sketch", "places"])

    return run


UNRELATED = "template long, sketch binary, places array<int>"


def in_parts(batches, columns: list[str]):
    """Values of the columns, of a bounded number of documents and of text at a time."""
    for whole in batches:
        part, size = [], 0
        for row in zip(*(whole.column(c).to_pylist() for c in columns)):
            part.append(row)
            size += len(row[-1])
            if len(part) == BATCH_DOCS or size > BATCH_CHARS:
                yield part
                part, size = [], 0
        if part:
            yield part


def parse(batches):
    """Lines with words: row, place, leaf, line, family, copy (the text's hash), and in each document's first one its sketch."""
    for part in in_parts(batches, ["row", "text"]):
        out: list[tuple] = []
        texts = [text.encode() for _, text in part]
        split = [[(line, line.split()) for line in text.split(b"\n")] for text in texts]
        shingles = text_shingles([word_hashes(chain.from_iterable(words for _, words in lines)) for lines in split])
        for (row, _), text, found, value in zip(part, texts, split, shingles):
            if not len(value):
                continue
            copy = hash_of(text)
            lines = [masked(line, words) for line, words in found]
            counts = [len(words) for words in lines]
            sketch = sketch_of(value, counts)
            for place, (words, family) in enumerate(zip(lines, families_of(value, counts))):
                if words:
                    out.append((row, place, path_of(words), hash_of(b" ".join(words)), family, copy, sketch))
                    sketch = None
        if out:
            row, place, *rest, sketch = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(place, pa.int32()), *(pa.array(x, pa.int64()) for x in rest),
                                              pa.array(sketch, pa.binary())], names=["row", "place", "leaf", "line", "family", "copy", "sketch"])


LINES = "row long, place int, leaf long, line long, family long, copy long, sketch binary"


def spell(batches):
    """Masked words of the different lines of some documents at a time, one blank between them."""
    for part in in_parts(batches, ["text"]):
        lines = {line for text, in part for line in text.encode().split(b"\n")}
        words = {b" ".join(w): path_of(w) for w in map(masked_words, lines) if w}
        yield pa.RecordBatch.from_arrays([pa.array(list(words.values()), pa.int64()), pa.array(list(map(hash_of, words)), pa.int64()),
                                          pa.array(list(words), pa.binary()).cast(pa.string())], names=["leaf", "line", "words"])


SPELLED = "leaf long, line long, words string"


def with_row(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def recurring_lines(rows: DataFrame, lines: DataFrame, least: int = LEAST) -> DataFrame:
    """Hashes of the masked lines whose template recurs, in column ``line``."""
    leaves = lines.select("leaf", "family").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    leaves = small(cut(leaves.select("leaf")))
    held = cut(lines.join(leaves, "leaf").select("leaf", "line", "family", "copy").distinct())
    spelled = cut(rows.mapInArrow(spell, SPELLED).join(leaves, "leaf").groupBy("line").agg(F.first("leaf").alias("leaf"), F.split(F.first("words"), " ").alias("words")))
    words = spelled.select("line", "leaf", F.size("words").alias("total"), F.posexplode("words").alias("at", "word")).withColumn("word", F.xxhash64("word"))
    # Constant words: held at their place by enough unrelated documents.
    families = held.select("line", "family").distinct()
    constant = (words.join(families, "line").groupBy("leaf", "at", "word", "family").agg(F.lit(1).alias("one"))
                .groupBy("leaf", "at", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("leaf", "at", "word"))
    # A template is its leaf (which holds the number of words) and its constant words with their places.
    fields = words.join(constant, ["leaf", "at", "word"]).groupBy("line", "leaf", "total").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("fields"))
    enough = F.size("fields") * 100 >= F.col("total") * CONSTANT_PERCENT
    shape = F.flatten(F.transform("fields", lambda x: F.array(x["at"].cast("long"), x["word"])))
    templates = cut(fields.where(enough).select("line", F.xxhash64("leaf", shape).alias("template")))
    # Different texts of each template, with the places of its lines; then those that are no copies of one another.
    found = cut(lines.join(small(templates), "line").groupBy("template", "copy").agg(F.min("row").alias("row"), F.collect_set("place").alias("places")))
    many = small(cut(found.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("template")))
    sketches = lines.where(F.col("sketch").isNotNull()).groupBy("row").agg(F.first("sketch").alias("sketch"))
    kept = found.join(many, "template").join(sketches, "row").select("template", "sketch", "places").mapInArrow(unrelated(least), UNRELATED)
    recurring = kept.repartition("template").sortWithinPartitions("template", "sketch").mapInArrow(unrelated(least), UNRELATED)
    recurring = recurring.where(F.col("sketch").isNull()).select("template")
    return cut(templates.join(recurring, "template").select("line"))


def dropped_places(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``row`` hash and places (from 0) of dropped lines, for documents that lose any."""
    rows = with_row(docs)
    lines = cut(rows.mapInArrow(parse, LINES))
    return lines.join(small(recurring_lines(rows, lines, least)), "line").groupBy("row").agg(F.collect_set("place").alias("places"))


def drop_recurring_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with ``cleaned`` (NULL text stays NULL), ``n_lines`` and ``n_dropped``."""
    row, lines, places = own(docs, "row"), own(docs, "lines"), own(docs, "places")
    out = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    lost = dropped_places(docs, least).select(F.col("row").alias(row), F.col("places").alias(places))
    out = out.join(lost, row, "left").withColumn(lines, F.split("text", "\n"))
    kept = F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(places, i), F.lit(False)))
    return (out.withColumn("cleaned", F.array_join(kept, "\n"))
            .withColumn("n_lines", F.coalesce(F.size(F.filter(lines, lambda x: F.length(F.trim(x, F.lit(BLANK))) > 0)), F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size(places), F.lit(0)).cast("long")).drop(row, lines, places))


def template_report(docs: DataFrame) -> DataFrame:
    """Lines and dropped lines of each document, and its remaining text."""
    return drop_recurring_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.col("cleaned").alias("text"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """``docs`` less the dropped lines; documents that lose all of their words go."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*names).alias("row"))
    out = drop_recurring_lines(packed).where("n_dropped = 0 or n_dropped < n_lines")
    new = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])
