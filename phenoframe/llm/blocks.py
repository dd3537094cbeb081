"""Blocks of documents that ask questions of the whole corpus.

Several operators need to know, for many small facts of each document (its
phrases, words or shingles), how often each occurs anywhere.  Documents are
dealt to blocks of bounded size by the hash of the row.  Each block reduces
its facts to distinct 64-bit keys with counts and sends them, packed in
binary rows, to the bucket of the key; the bucket adds up what all blocks
sent and answers each block with what it needs; the block's documents meet
the answers in a cogroup.  A frequent fact costs one entry per block, not
one per row, and buckets are even because keys are hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes that a block should hold, and the fewest blocks.
BLOCK_BYTES, LEAST_BLOCKS = 4_000_000, 64
#: Facts that a bucket should hold, and the fewest buckets.
BUCKET_FACTS, LEAST_BUCKETS = 500_000, 64

FACTS = "bucket int, block int, number long, keys binary, values binary"
ANSWERS = "block int, kind int, number long, keys binary, values binary"


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def in_blocks(docs: DataFrame, total: int) -> DataFrame:
    """``doc_id`` and ``text`` (NULL as empty) with the ``row``'s hash and its ``block``; ``total`` is the sum of the texts' bytes."""
    n = max(LEAST_BLOCKS, total // BLOCK_BYTES)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    return rows.withColumn("block", F.pmod("row", F.lit(n)).cast("int"))


def n_buckets(facts: int) -> int:
    return max(LEAST_BUCKETS, facts // BUCKET_FACTS)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array of numbers, all lowest ones first, so that the empty high ones compress."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as the steps between them."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def facts(block: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[dict]:
    """Rows for sorted keys and a record of values for each."""
    at = bucket_of(keys, buckets)
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(keys) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield {"bucket": int(at[a]), "block": block, "number": int(b - a), "keys": pack(keys[a:b]), "values": planes(values[a:b])}


def answer(block: int, kind: int, keys: np.ndarray, values: np.ndarray) -> dict:
    return {"block": block, "kind": kind, "number": len(keys), "keys": pack(keys), "values": planes(values)}


def table(rows: Iterable[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(list(rows), schema=schema)


FACT_ROWS = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("number", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
ANSWER_ROWS = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("number", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])


def read_facts(rows: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, values and blocks of a bucket's rows, behind one another."""
    number = rows.column("number").to_numpy()
    blocks = np.repeat(rows.column("block").to_numpy(), number)
    keys = [unpack(x) for x in rows.column("keys").to_pylist()]
    values = [from_planes(x, kind) for x in rows.column("values").to_pylist()]
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64), np.concatenate(values) if values else np.zeros(0, kind), blocks)


def read_answers(rows: pa.Table, kind: int, of) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their values, of the answers of one kind."""
    found = [(unpack(r["keys"]), from_planes(r["values"], of)) for r in rows.to_pylist() if r["kind"] == kind]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, of)
    keys, values = np.concatenate([k for k, _ in found]), np.concatenate([v for _, v in found])
    order = np.argsort(keys, kind="stable")
    return keys[order], values[order]


def look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted known ones, and whether it is one."""
    at = np.searchsorted(known, keys)
    held = at < len(known)
    held[held] = known[at[held]] == keys[held]
    return np.where(held, at, 0), held
