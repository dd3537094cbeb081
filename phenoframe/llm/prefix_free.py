"""Removal of repeated byte strings by prefix-free parsing.

A byte string of ``SPAN`` bytes is repeated when the same bytes start
anywhere else, in the same text or another one; every byte that a repeated
string covers is removed.  Strings are judged on the input.

Parsing.  A rolling hash of ``GRAM`` bytes runs over each text, and each
span is triggered by the least hash inside it (the rightmost of equals).
Spans that follow one another under the same trigger form a *phrase*: the
bytes from the first span's start to the last one's end.  Triggers depend
on the bytes of the span alone, so equal spans have their trigger at the
same place and lie in phrases of the same trigger gram.

Dictionary and parse.  Blocks send their distinct phrases with counts to the
bucket of the trigger gram.  All spans of a phrase that occurs twice are
repeated, and those of a phrase that is alone with its trigger are not; no
byte of either is looked at again.  What is left are different phrases of
one trigger: the ends of repeated passages.  One block that holds such a
phrase sends its bytes to the bucket, which puts the suffixes of its part of
the dictionary in order by trigger, place and first ``SPAN`` bytes; equal
neighbours are repeated.  A phrase holds its spans whole, so of the parse
only the number of times that each phrase occurs is needed.

Bytes are compared by 64-bit hashes, among phrases or suffixes of the same
trigger gram.

Defined results: NULL counts as the empty text; texts under ``SPAN`` bytes
keep everything; repeated rows repeat each other; ids may be NULL or equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phenoframe.llm import blocks

SPAN, GRAM = 200, 40
#: Places that the trigger gram can have in a span.
PLACES = SPAN - GRAM + 1
#: Span starts handled by one set of arrays.
SEGMENT = 1 << 18

# Hash constants: an odd base with its inverse, and a number for each byte.
BASE = 0x9E3779B97F4A7C15 | 5
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = blocks.mix(np.arange(1, 257, dtype=np.uint64))

REPEATED, SHARED_TRIGGER, SPEAKER = 1, 2, 4
PHRASE = np.dtype([("phrase", np.uint64), ("count", np.uint32)])
VERDICT = np.dtype([("phrase", np.uint64), ("flags", np.uint8)])
SPANS = np.dtype([("phrase", np.uint64), ("repeated", np.uint8, -(-PLACES // 8))])
SPOKEN = "bucket int, block int, number long, keys binary, values binary, bytes binary"
PART = np.dtype([("phrase", np.uint64), ("length", np.uint16), ("place", np.uint8), ("again", np.uint8)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


SIZE = SEGMENT + PLACES + 2 * SPAN
POWERS, INVERSES = powers(BASE, SIZE), powers(INVERSE, SIZE)


class Hashes:
    """Rolling hashes of any stretch of a piece of the buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * POWERS[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return blocks.mix((self.sums[start + length] - self.sums[start]) * INVERSES[start])


def least_in_windows(h: np.ndarray, size: int) -> np.ndarray:
    """Place of the least value in each window of ``size`` values (the rightmost of equals)."""
    n = len(h) - size + 1
    low = np.uint64(0xFFFFFFFF)
    packed = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    padded = np.full(-(-len(h) // size) * size, np.uint64(2 ** 64 - 1))
    padded[:len(h)] = packed
    rows = padded.reshape(-1, size)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[size - 1:size - 1 + n])
    return (low - (least & low)).astype(np.int64)


def join_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the edges between them."""
    raw = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint8), edges


def parse(data: np.ndarray, edges: np.ndarray):
    """Phrases of the texts, in order: first span start, number of spans, trigger's place in the first, gram and phrase hashes."""
    out = []
    for a in range(0, max(0, len(data) - SPAN + 1), SEGMENT):
        piece = data[a:a + SIZE]
        if len(piece) < SPAN:
            break
        hashes = Hashes(piece)
        grams = hashes.of(np.arange(len(piece) - GRAM + 1), GRAM)
        trigger = least_in_windows(grams, PLACES)
        n = len(trigger)
        # A span must end inside the text where it starts.
        text = np.searchsorted(edges, np.arange(a, a + n), "right")
        whole = np.arange(a, a + n) + SPAN <= edges[np.minimum(text, len(edges) - 1)]
        new = np.r_[True, (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])]
        if a:  # a phrase that began before this segment is not its own
            new[0] = False
            new[0] = before != (trigger[0] + a, text[0], whole[0])
        start = np.flatnonzero(new)
        end = np.r_[start[1:], n]
        own = (start < SEGMENT) & whole[start]
        start, end = start[own], end[own]
        place, spans = trigger[start] - start, end - start
        phrase = hashes.of(start, spans + (SPAN - 1)) ^ blocks.mix((place * SPAN + spans).astype(np.uint64))
        out.append((start + a, spans, place, grams[trigger[start]], phrase))
        if n > SEGMENT:
            last = SEGMENT - 1
            before = (trigger[last] + a, text[last], whole[last])
    if not out:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*out)]


def distinct(gram: np.ndarray, phrase: np.ndarray, *more: np.ndarray):
    """Order of (gram, phrase) pairs, where each different one begins in it, and the sorted arrays."""
    order = np.lexsort((phrase, gram))
    gram, phrase = gram[order], phrase[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])] if len(gram) else np.zeros(0, bool)
    return np.flatnonzero(new), gram, phrase, [m[order] for m in more]


def records(kind: np.dtype, **columns) -> np.ndarray:
    out = np.zeros(len(next(iter(columns.values()))), dtype=kind)
    for name, column in columns.items():
        out[name] = column
    return out


def verdicts(gram: np.ndarray, phrase: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Flags of each phrase, from a block's answers (sorted by gram)."""
    flags = np.zeros(len(gram), dtype=np.uint8)
    if len(keys):
        both = blocks.mix(keys) ^ values["phrase"]
        order = np.argsort(both)
        at, held = blocks.look_up(blocks.mix(gram) ^ phrase, both[order])
        flags[held] = values["flags"][order[at[held]]]
    return flags


def phrases_of_block(buckets: int):
    """Step 1: the distinct phrases of a block."""

    def run(rows: pa.Table) -> pa.Table:
        data, edges = join_texts(rows.column("text").to_pylist())
        _, _, _, gram, phrase = parse(data, edges)
        first, gram, phrase, _ = distinct(gram, phrase)
        count = np.diff(np.r_[first, len(gram)])
        values = records(PHRASE, phrase=phrase[first], count=count)
        return blocks.table(blocks.facts(rows.column("block")[0].as_py(), gram[first], values, buckets), blocks.FACT_ROWS)

    return run


def judge_phrases(rows: pa.Table) -> pa.Table:
    """Step 2: which phrases occur twice, and which share their trigger with another."""
    gram, values, block = blocks.read_facts(rows, PHRASE)
    first, gram, phrase, (count, block) = distinct(gram, values["phrase"], values["count"], block)
    if not len(gram):
        return blocks.table([], blocks.ANSWER_ROWS)
    senders = np.diff(np.r_[first, len(gram)])
    total = np.add.reduceat(count.astype(np.int64), first)
    new = np.r_[True, gram[first][1:] != gram[first][:-1]]
    start = np.flatnonzero(new)
    variants = np.diff(np.r_[start, len(first)])
    flags = np.repeat((total >= 2) * REPEATED + np.repeat(variants >= 2, variants) * SHARED_TRIGGER, senders).astype(np.uint8)
    speaks = np.zeros(len(gram), dtype=bool)
    speaks[first] = True
    flags += ((flags & SHARED_TRIGGER > 0) & speaks) * np.uint8(SPEAKER)
    told = np.flatnonzero(flags)
    told = told[np.argsort(block[told], kind="stable")]
    out = []
    edges = np.flatnonzero(np.r_[True, block[told][1:] != block[told][:-1], True]) if len(told) else []
    for a, b in zip(edges[:-1], edges[1:]):
        of = told[a:b]
        out.append(blocks.answer(int(block[of[0]]), REPEATED, gram[of], records(VERDICT, phrase=phrase[of], flags=flags[of])))
    return blocks.table(out, blocks.ANSWER_ROWS)


def speak(buckets: int):
    """Step 3: the bytes of phrases that share their trigger, from one block each."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and told.num_rows:
            data, edges = join_texts(docs.column("text").to_pylist())
            start, spans, place, gram, phrase = parse(data, edges)
            flags = verdicts(gram, phrase, *blocks.read_answers(told, REPEATED, VERDICT))
            of = np.flatnonzero(flags & SPEAKER)
            first, g, p, (of,) = distinct(gram[of], phrase[of], of)
            of, g, p = of[first], g[first], p[first]
            length = spans[of] + SPAN - 1
            values = records(PART, phrase=p, length=length, place=place[of], again=flags[of] & REPEATED)
            block = docs.column("block")[0].as_py()
            at = 0
            for row in blocks.facts(block, g, values, buckets):
                end = at + row["number"]
                rows.append(row | {"bytes": b"".join(data[x:x + n].tobytes() for x, n in zip(start[of[at:end]].tolist(), length[at:end].tolist()))})
                at = end
        return blocks.table(rows, blocks.FACT_ROWS.append(pa.field("bytes", pa.binary())))

    return run


def compare_suffixes(rows: pa.Table) -> pa.Table:
    """Step 4: the spans of lone phrases that another phrase of their trigger holds too."""
    gram, values, block = blocks.read_facts(rows, PART)
    if not len(gram):
        return blocks.table([], blocks.ANSWER_ROWS)
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype=np.uint8)
    length = values["length"].astype(np.int64)
    offset = np.cumsum(length) - length
    order = np.argsort(gram, kind="stable")
    repeated = np.zeros((len(gram), SPANS["repeated"].shape[0] * 8), dtype=bool)
    # Whole triggers are taken together, so many at a time that their bytes fill one set of arrays.
    new = np.r_[True, gram[order][1:] != gram[order][:-1]]
    groups = np.flatnonzero(new)
    ends = np.cumsum(length[order])
    at = 0
    while at < len(order):
        limit = np.searchsorted(ends, (ends[at - 1] if at else 0) + SEGMENT * 4, "right")
        inside = groups[(groups > at) & (groups <= limit)]
        stop = int(inside[-1]) if len(inside) else int(groups[groups > at][0]) if (groups > at).any() else len(order)
        if limit >= len(order):
            stop = len(order)
        of = order[at:stop]
        suffix, owner, span = [], [], []
        for a in range(0, len(of), 500):  # 500 phrases fit the power tables
            part = of[a:a + 500]
            hashes = Hashes(np.concatenate([data[offset[i]:offset[i] + length[i]] for i in part]))
            spans = length[part] - SPAN + 1
            local = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
            begin = np.repeat(np.cumsum(length[part]) - length[part], spans) + local
            place = np.repeat(values["place"][part].astype(np.int64), spans) - local
            suffix.append(blocks.mix(np.repeat(gram[part], spans) + place.astype(np.uint64)) ^ hashes.of(begin, SPAN))
            owner.append(np.repeat(part, spans))
            span.append(local)
        suffix, owner, span = np.concatenate(suffix), np.concatenate(owner), np.concatenate(span)
        rank = np.argsort(suffix, kind="stable")
        same = np.r_[False, suffix[rank][1:] == suffix[rank][:-1]]
        twice = rank[same | np.r_[same[1:], False]]
        repeated[owner[twice], span[twice]] = True
        at = stop
    told = np.flatnonzero((values["again"] == 0) & repeated.any(axis=1))
    told = told[np.lexsort((gram[told], block[told]))]
    edges = np.flatnonzero(np.r_[True, block[told][1:] != block[told][:-1], True]) if len(told) else []
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        of = told[a:b]
        bits = np.packbits(repeated[of], axis=1)
        out.append(blocks.answer(int(block[of[0]]), SPEAKER, gram[of], records(SPANS, phrase=values["phrase"][of], repeated=bits)))
    return blocks.table(out, blocks.ANSWER_ROWS)


def covered(data: np.ndarray, edges: np.ndarray, told: pa.Table) -> np.ndarray:
    """Flag of each byte that a repeated span covers."""
    start, spans, _, gram, phrase = parse(data, edges)
    change = np.zeros(len(data) + 1, dtype=np.int32)
    flags = verdicts(gram, phrase, *blocks.read_answers(told, REPEATED, VERDICT))
    whole = np.flatnonzero(flags & REPEATED)
    np.add.at(change, start[whole], 1)
    np.add.at(change, start[whole] + spans[whole] + SPAN - 1, -1)
    keys, values = blocks.read_answers(told, SPEAKER, SPANS)
    if len(keys):
        both = blocks.mix(keys) ^ values["phrase"]
        order = np.argsort(both)
        at, held = blocks.look_up(blocks.mix(gram) ^ phrase, both[order])
        of = np.flatnonzero(held)
        bits = np.unpackbits(values["repeated"][order[at[of]]], axis=1)
        row, span = np.nonzero(bits)
        begin = start[of[row]] + span
        np.add.at(change, begin, 1)
        np.add.at(change, begin + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


def cut_block():
    """Step 5: the remaining bytes of each document."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        data, edges = join_texts(docs.column("text").to_pylist())
        gone = covered(data, edges, told)
        rows = []
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            out = gone[a:b]
            kept = data[a:b][~out].tobytes()
            rows.append((b - a, int(out.sum()), int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.Table.from_arrays(
            [docs.column("doc_id").combine_chunks(), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Bytes, removed bytes and runs of each document, and what is left of it."""
    total = blocks.text_bytes(docs)
    buckets = blocks.n_buckets(total // 60)  # a phrase for about so many bytes
    placed = blocks.in_blocks(docs, total)
    phrases = placed.groupBy("block").applyInArrow(phrases_of_block(buckets), blocks.FACTS)
    judged = phrases.groupBy("bucket").applyInArrow(judge_phrases, blocks.ANSWERS)
    by_block = placed.groupBy("block")
    spoken = by_block.cogroup(judged.groupBy("block")).applyInArrow(speak(buckets), SPOKEN)
    compared = spoken.groupBy("bucket").applyInArrow(compare_suffixes, blocks.ANSWERS)
    told = judged.unionByName(compared)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_block.cogroup(told.groupBy("block")).applyInArrow(
        cut_block(), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
