"""Token counts of texts under a byte-pair vocabulary, by rank-synchronous array merging.

The distinct pre-tokens of a batch of documents lie behind one another in
flat numpy arrays.  In each round every sequence finds its best-scored
adjacent pair, and all sequences merge theirs at once; when no sequence has
a pair left, the surviving symbols are counted.

Where a sequence holds its best
pair several times and no merge makes a pair as good or better, all are
merged in the same round; else only the leftmost one is, as one at a time
would.

Characters without a piece count as their UTF-8 bytes.

Defined results: NULL and empty texts have no tokens; repeated rows are
counted each; very long words take rounds in proportion to their different
pairs, and memory in proportion to their length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phenoframe.llm.pieces import FILE_SPACE, PRE_TOKEN, Vocabulary, code_points, read_vocabulary, utf8_length

TOKEN_LIMIT = 4096
#: Characters of distinct pre-tokens merged together.
BATCH_CHARS = 300_000
#: Documents taken from a batch at a time.
BATCH_DOCS = 1_000
#: Counts that a worker remembers between batches; beyond that it starts anew.
KNOWN = 300_000
NO_PAIR = np.iinfo(np.int32).max


class Merges:
    """Which symbols there are, and the rank of each pair that makes a piece."""

    def __init__(self, vocabulary: Vocabulary):
        normal = {vocabulary.texts[i]: i for i in vocabulary.ids}
        # Equal scores share a rank; better scores have lower ranks.
        levels = {s: r for r, s in enumerate(sorted({vocabulary.scores[i] for i in normal.values()}, reverse=True))}
        self.rank = np.full(len(vocabulary.texts), NO_PAIR, dtype=np.int32)
        for i in normal.values():
            self.rank[i] = levels[vocabulary.scores[i]]
        self.size = np.int64(len(vocabulary.texts))
        pairs = {normal[t[:k]] * len(vocabulary.texts) + normal[t[k:]]: i
                 for t, i in normal.items() for k in range(1, len(t)) if t[:k] in normal and t[k:] in normal}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.full(0x110000, -1, dtype=np.int64)
        for t, i in normal.items():
            if len(t) == 1:
                self.single[ord(t)] = i

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Ids of single characters; -1 where there is none."""
        return self.single[points]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of symbols make; -1 where there is none."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)

    def ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made < 0, NO_PAIR, self.rank[made])


def runs(flags: np.ndarray) -> np.ndarray:
    """Position of each flagged element within its run of flagged neighbours."""
    at = np.arange(len(flags))
    start = np.maximum.accumulate(np.where(flags, 0, at + 1))
    return at - start


def count_symbols(texts: list[str], merges: Merges) -> np.ndarray:
    """Tokens of each pre-token (no empty ones)."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    points = code_points("".join(texts))
    symbol = merges.symbols(points)
    owner = np.repeat(np.arange(len(texts)), sizes)
    counts = np.zeros(len(texts), dtype=np.int64)
    # Characters without a piece never merge: all their bytes but one are added here.
    np.add.at(counts, owner[symbol < 0], utf8_length(points[symbol < 0]) - 1)
    counts += sizes

    # ``made[i]`` is the piece that symbol i and the next one of its sequence make.
    def pieces(at: np.ndarray) -> np.ndarray:
        inside = at + 1 < len(symbol)
        after = np.where(inside, at + 1, at)
        return np.where(inside & (owner[after] == owner[at]), merges.merged(symbol[at], symbol[after]), -1)

    made = pieces(np.arange(len(symbol)))
    while len(symbol):
        rank = merges.ranks(made)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best = np.minimum.reduceat(rank, first)
        length = np.diff(np.r_[first, len(symbol)])
        # Sequences without a pair are done.
        alive = np.repeat(best < NO_PAIR, length)
        if not alive.all():
            symbol, made, owner, rank = symbol[alive], made[alive], owner[alive], rank[alive]
            length = length[best < NO_PAIR]
            best = best[best < NO_PAIR]
            if not len(symbol):
                break
        target = np.repeat(best, length)
        sequence = np.repeat(np.arange(len(length)), length)
        hit = rank == target
        hit &= runs(hit) % 2 == 0  # overlapping pairs: every other one from the left
        at = np.flatnonzero(hit)
        leftmost = np.r_[True, sequence[at[1:]] != sequence[at[:-1]]]
        if not leftmost.all():
            # Would a merge make a pair that is as good or better?  Then that sequence goes on from its leftmost alone.
            after = symbol.copy()
            after[at] = made[at]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[at + 1] = True
            kept = np.flatnonzero(~gone)
            left, right = kept[:-1], kept[1:]
            new = (sequence[left] == sequence[right]) & (hit[left] | hit[right])
            left, right = left[new], right[new]
            ranks = merges.ranks(merges.merged(after[left], after[right]))
            mixed = np.zeros(len(length), dtype=bool)
            mixed[sequence[left[ranks <= target[left]]]] = True
            # Pairs of other pieces with the same rank count as such too.
            other = made[at] != made[at[np.maximum.accumulate(np.where(leftmost, np.arange(len(at)), 0))]]
            mixed[sequence[at[other]]] = True
            at = at[leftmost | ~mixed[sequence[at]]]
        symbol[at] = made[at]
        np.subtract.at(counts, owner[at], 1)
        keep = np.ones(len(symbol), dtype=bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbol, made, owner = symbol[keep], made[keep], owner[keep]
        changed = moved[at]
        touched = np.zeros(len(symbol), dtype=bool)
        touched[changed] = True
        touched[changed[changed > 0] - 1] = True
        touched = np.flatnonzero(touched)
        made[touched] = pieces(touched)
    return counts


@lru_cache(maxsize=1)
def load(path: str) -> Merges:
    return Merges(read_vocabulary(path))


def marked(text: str) -> str:
    """A text as the library sees it: a space before it, and its space mark taken for a space."""
    return " " + text.replace(FILE_SPACE, " ") if text else ""


def count_texts(texts: list[str | None], merges: Merges, known: dict[str, int] | None = None) -> list[int]:
    """Tokens of each text; ``known`` holds the counts of pre-tokens met before and gets the new ones."""
    known = {} if known is None else known
    rows = [PRE_TOKEN.findall(marked(text or "")) for text in texts]
    new = list({w for row in rows for w in row} - known.keys())
    start = 0
    ends = np.cumsum([len(w) for w in new])
    while start < len(new):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BATCH_CHARS)))
        known.update(zip(new[start:stop], count_symbols(new[start:stop], merges).tolist()))
        start = stop
    totals = [sum(map(known.__getitem__, row)) for row in rows]
    if len(known) > KNOWN:
        known.clear()
    return totals


def token_counts(docs: DataFrame, model: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Bytes and tokens of each document's text; ``model`` is a path that every worker can read."""

    def count(batches):
        merges, known = load(model), {}
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(start, BATCH_DOCS)
                texts = batch.column("text").to_pylist()
                tokens = count_texts(texts, merges, known)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
