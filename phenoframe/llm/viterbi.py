"""SentencePiece encoding by batched Viterbi search, and decoding.

The distinct pre-tokens of equal length form a matrix of code points.  All
its rows advance together from position to position: the substrings that
start there are hashed one character longer at a time and looked up among
the sorted piece keys, and a vectorised maximum keeps, for each end, the
best score, the start it came from and the piece.  Following the starts
back from the end gives the segmentation with the highest total score; of
equal ones, the one whose last piece is longest.

The pieces and scores are those of the vocabulary file.  A character without
a piece of its own may be covered by the pieces of its UTF-8 bytes, at a
score below every trained one.  A space is put before each text and taken
off by the decoder, so decoding gives back every text exactly.

Defined results: NULL gives NULL pieces (and decodes to NULL), the empty
text no pieces; repeated rows are encoded each; a very long word takes time
and memory in proportion to its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from phenoframe.llm.pieces import PRE_TOKEN, Vocabulary, code_points, extend, read_vocabulary

#: Characters in one matrix of equal-length words.
MATRIX_CHARS = 400_000
#: Documents taken from a batch at a time.
BATCH_DOCS = 500
#: Segmentations that a worker remembers between batches; beyond that it starts anew.
KNOWN = 200_000
#: Scores below this are marks of untrained pieces, not log-probabilities.
UNTRAINED = -1e8


@lru_cache(maxsize=1)
def load(path: str) -> Vocabulary:
    return read_vocabulary(path)


def best_pieces(points: np.ndarray, vocabulary: Vocabulary, fallback: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words of one length (a row of code points each): ids in order, row after row, and the number in each row.

    A character covered by its bytes has the id -1 - (its code point).
    """
    n, size = points.shape
    columns = np.ascontiguousarray(points.T)
    score = np.full((size + 1, n), -np.inf)
    score[0] = 0
    start = np.zeros((size + 1, n), dtype=np.int32)
    piece = np.zeros((size + 1, n), dtype=np.int64)
    every = np.arange(n)
    for i in range(size):
        # Rows drop out when their substring begins no piece.
        rows, hashes = every, np.zeros(n, dtype=np.uint64)
        for j in range(i, min(size, i + vocabulary.longest)):
            hashes = extend(hashes, columns[j][rows])
            found, begins = vocabulary.find_beginning(hashes)
            if j == i:
                value = score[i] + np.where(found >= 0, vocabulary.scores[found], fallback)
                found = np.where(found >= 0, found, -1 - columns[j].astype(np.int64))
                to = rows
            else:
                hit = np.flatnonzero(found >= 0)
                to, found = rows[hit], found[hit]
                value = score[i][to] + vocabulary.scores[found]
            better = value > score[j + 1][to]
            to = to[better]
            score[j + 1][to] = value[better]
            start[j + 1][to] = i
            piece[j + 1][to] = found[better]
            rows, hashes = rows[begins], hashes[begins]
            if not rows.size:
                break
    rows = every
    end = np.full(n, size)
    taken = np.zeros((n, size), dtype=bool)
    while rows.size:
        taken[rows, end - 1] = True
        end = start[end, rows]
        rows, end = rows[end > 0], end[end > 0]
    return piece[1:].T[taken], taken.sum(axis=1)


class Encoder:
    """Segmentations of pre-tokens, remembered in one flat array with the end of each."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        trained = vocabulary.scores[vocabulary.ids]
        self.fallback = float(trained[trained > UNTRAINED].min()) - 10
        self.plain = [t.encode() for t in vocabulary.texts]
        for byte, i in enumerate(vocabulary.byte_ids.tolist()):
            self.plain[i] = bytes([byte])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def learn(self, words: list[str]) -> None:
        """Segment new words, those of one length together."""
        words = sorted(words, key=len)
        sizes = np.array([len(w) for w in words])
        flats, counts = [], []
        at = 0
        while at < len(words):
            size = sizes[at]
            stop = min(int(np.searchsorted(sizes, size, "right")), at + max(1, MATRIX_CHARS // int(size)))
            points = code_points("".join(words[at:stop])).reshape(stop - at, size)
            ids, number = best_pieces(points, self.vocabulary, self.fallback)
            if (ids < 0).any():
                ids, number = self.with_bytes(ids, number)
            flats.append(ids.astype(np.int32))
            counts.append(number)
            at = stop
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.flat = np.concatenate([self.flat, *flats])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])

    def with_bytes(self, ids: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, with the pieces of their bytes for characters without one."""
        row = np.repeat(np.arange(len(number)), number)
        out, rows = [], []
        edges = np.flatnonzero(ids < 0)
        for before, at in zip(np.r_[0, edges[:-1] + 1], edges):
            spelled = self.vocabulary.byte_ids[list(chr(-1 - ids[at]).encode("utf-8", "surrogatepass"))]
            out += [ids[before:at], spelled]
            rows += [row[before:at], np.full(len(spelled), row[at])]
        out.append(ids[edges[-1] + 1:])
        rows.append(row[edges[-1] + 1:])
        return np.concatenate(out), np.bincount(np.concatenate(rows), minlength=len(number))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and the edges between them."""
        rows = [PRE_TOKEN.findall(" " + t) if t else [] for t in texts]
        if len(self.index) > KNOWN:
            self.forget()
        new = {w for row in rows for w in row} - self.index.keys()
        if new:
            self.learn(list(new))
        at = np.array([self.index[w] for row in rows for w in row], dtype=np.int64)
        first, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int64)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``docs`` with ``piece_ids``, ``n_pieces`` and ``round_trip`` (decoding gives the text back).

    Input columns of those names are replaced.
    """
    added = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_pieces", T.LongType()),
                          T.StructField("round_trip", T.BooleanType())])
    docs = docs.drop(*added.names)
    names = docs.columns

    def encode(batches):
        encoder = Encoder(load(model))
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                texts = batch.column("text").to_pylist()
                ids, edges = encoder.encode(texts)
                missing = np.array([t is None for t in texts], dtype=bool)
                same = [t is None or encoder.decode(ids[a:b].tolist()) == t for t, a, b in zip(texts, edges[:-1].tolist(), edges[1:].tolist())]
                offsets = pa.array(edges, pa.int32(), mask=np.r_[missing, False])
                number = pa.array(np.diff(edges), pa.int64(), mask=missing)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), number, pa.array(same, pa.bool_(), mask=missing)],
                    names=[*names, *added.names])

    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, *added.fields]))


def decode_documents(encoded: DataFrame, model: str, into: str = "text") -> DataFrame:
    """``encoded`` with the text of its ``piece_ids`` in column ``into``."""
    encoded = encoded.drop(into) if into in encoded.columns else encoded
    names = encoded.columns

    def decode(batches):
        encoder = Encoder(load(model))
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column("piece_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
