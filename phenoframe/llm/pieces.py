"""The vocabulary of a sentencepiece model file, as arrays for batched lookups.

A pre-token is a run of spaces with the characters after it: no piece has a
space behind another character (checked when the file is read), so no
segmentation crosses that border.

Only the file's pieces, scores and types are read.  A substring is found by
its 64-bit polynomial hash among the sorted hashes of all pieces (checked to
be distinct when the table is built).
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the model file format: message fields and piece types.
PIECES, PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 1, 2, 3
NORMAL, BYTE = 1, 6
# Fixed value: the character that stands for a space in the file; here pieces hold the space itself.
FILE_SPACE = "▁"
#: Multiplier of the substring hash; any large odd number does.
BASE = np.uint64(0x9E3779B97F4A7C15)
PRE_TOKEN = re.compile(" *[^ ]+| +")


def fields(message: bytes):
    """(field number, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at:at + size]
        at += size


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def extend(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings, each one character longer."""
    return (hashes ^ (points.astype(np.uint64) + np.uint64(1))) * BASE ^ (hashes >> np.uint64(29))


@dataclass
class Vocabulary:
    texts: list[str]
    scores: np.ndarray  # by id
    hashes: np.ndarray  # of the normal pieces, sorted
    ids: np.ndarray  # in the order of the hashes
    byte_ids: np.ndarray  # id of each byte's piece
    longest: int  # characters of the longest normal piece
    beginnings: np.ndarray  # hashes of all beginnings of normal pieces, sorted
    whole: np.ndarray  # id of the piece that each beginning is, -1 if it is only a part of some

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes; -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)


    def find_beginning(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces with these hashes (-1 where there is none), and which hashes begin a piece (or are one)."""
        at = np.minimum(np.searchsorted(self.beginnings, hashes), len(self.beginnings) - 1)
        begins = self.beginnings[at] == hashes
        return np.where(begins, self.whole[at], -1), begins


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        model = f.read()
    texts, scores, kinds = [], [], []
    for name, value in fields(model):
        if name == PIECES:
            piece = dict(fields(value))
            texts.append(piece[PIECE_TEXT].decode().replace(FILE_SPACE, " "))
            scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, bytes(4)))[0])
            kinds.append(piece.get(PIECE_TYPE, NORMAL))
    normal = [i for i, kind in enumerate(kinds) if kind == NORMAL]
    if any(" " in texts[i].lstrip(" ") for i in normal):
        raise ValueError("a piece has a space after another character")
    hashes = np.array([hash_of(texts[i]) for i in normal], dtype=np.uint64)
    order = np.argsort(hashes)
    if (hashes[order][1:] == hashes[order][:-1]).any():
        raise ValueError("two pieces share a hash")
    beginnings = np.unique(np.concatenate([prefix_hashes(texts[i]) for i in normal]))
    whole = np.full(len(beginnings), -1, dtype=np.int64)
    whole[np.searchsorted(beginnings, hashes)] = normal
    byte_ids = {int(texts[i][3:5], 16): i for i, kind in enumerate(kinds) if kind == BYTE}
    return Vocabulary(texts, np.array(scores), hashes[order], np.array(normal, dtype=np.int64)[order],
                      np.array([byte_ids[b] for b in range(256)], dtype=np.int64), max(len(texts[i]) for i in normal), beginnings, whole)


def prefix_hashes(text: str) -> np.ndarray:
    """Hashes of the first character, the first two, and so on."""
    value, out = np.zeros(1, dtype=np.uint64), []
    for point in code_points(text):
        value = extend(value, point[None])
        out.append(value)
    return np.concatenate(out) if out else value[:0]


def hash_of(text: str) -> int:
    return int(prefix_hashes(text)[-1])


def utf8_length(points: np.ndarray) -> np.ndarray:
    """Bytes that each code point takes in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
