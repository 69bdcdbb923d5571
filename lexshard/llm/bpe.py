"""Problem 6: token ids of every text by a public byte-level BPE vocabulary, by speculation and verification.

A text is split by the vocabulary's pattern; most pieces are words seen before. For each new word the longest tokens
that match are taken from left to right: a guess. A token sequence is what the merges would give exactly if every
adjacent pair is compatible, that is if no merge crosses the border of the two before both are complete. All pairs of
all new words of a batch are tested at once on arrays; only words with a failing pair are merged one merge at a time.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.session import spread, table

#: Where the vocabulary lies; never copied here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary is broadcast; one of more tokens than this is refused.
MAX_TOKENS = 1 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 400_000
_NEVER = np.int64(1) << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_TOKENS:
        raise ValueError(f"{len(ranks)} tokens; at most {MAX_TOKENS} are broadcast")
    return ranks


def merged(word: bytes, ranks: dict[bytes, int]) -> tuple[list[int], tuple[int, int] | None]:
    """The ids of a word by exact merging, lowest rank first and leftmost among equals, and the last merge's parts.

    A heap over the borders, with links to the living neighbours: n log n for words of any length.
    """
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    last = None
    while heap:
        rank, i = heapq.heappop(heap)
        j = end[i] if alive[i] else n
        if j >= n or ranks.get(word[i : end[j]]) != rank:
            continue  # one of the two has changed since
        last = (ranks[word[i:j]], ranks[word[j : end[j]]])
        alive[j], end[i] = False, end[j]
        if end[i] < n:
            before[end[i]] = i
            if (r := ranks.get(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out, last


class Vocabulary:
    """Ranks, and the tables that compatibility is read from; small and of fixed size, so it can be broadcast."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        size = max(ranks.values()) + 1
        parts = np.full((size, 2), -1, np.int64)
        self.guessed: dict[bytes, int] = {}  # tokens that merging really gives for their own bytes
        for token, rank in ranks.items():
            if len(token) == 1:
                self.guessed[token] = rank
                continue
            ids, last = merged(token, ranks)
            if ids == [rank]:
                parts[rank] = last
                self.guessed[token] = rank
        self.longest = max(map(len, self.guessed), default=1)
        self.right, self.right_dies = self._spine(parts, 1)
        self.left, self.left_dies = self._spine(parts, 0)
        self.made = np.where(parts[:, 0] >= 0, np.arange(size), -1)  # when a token comes into being; bytes are there from the start
        keys, rank = [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    keys.append(a * size + b)
                    rank.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.size, self.pairs, self.pair_rank = size, np.array(keys, np.int64)[order], np.array(rank, np.int64)[order]

    @staticmethod
    def _spine(parts: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token the pieces at its edge from the single byte up to itself, and the rank that ends each piece.

        Rows are padded with the token itself, which never ends.
        """
        rows, dies = [np.arange(len(parts))], [np.full(len(parts), _NEVER)]
        while True:
            inner = parts[rows[-1], side]
            if (inner < 0).all():
                break
            # a byte has no inner piece: it stays, with an ending before any time
            rows.append(np.where(inner >= 0, inner, rows[-1]))
            dies.append(np.where(inner >= 0, rows[-2], -2))
        depth = [d >= 0 for d in dies]
        levels = np.sum(depth, axis=0)
        chain_, ends = np.stack(rows[::-1], 1), np.stack(dies[::-1], 1)
        shift = (len(rows) - levels)[:, None] + np.arange(len(rows))[None, :]
        shift = np.minimum(shift, len(rows) - 1)
        return np.take_along_axis(chain_, shift, 1).astype(np.int32), np.take_along_axis(ends, shift, 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair gives exactly the two tokens.

        The two edges are followed through time: the piece that ends first gives way to the next (the left one if
        both end at the same rank, as merges of one rank run from left to right). The pair fails if at some moment
        the pieces at the border form a token of a rank that comes before the left piece's end and not after the
        right one's.
        """
        ok = np.ones(len(a), bool)
        i, j = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        while len(live):
            ta, tb, ia, jb = a[live], b[live], i[live], j[live]
            x, y, dx, dy = self.right[ta, ia].astype(np.int64), self.left[tb, jb].astype(np.int64), self.right_dies[ta, ia], self.left_dies[tb, jb]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            rank = np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER + 1)
            meet = (self.made[x] <= dy) & (self.made[y] < dx)
            fails = meet & (rank < dx) & (rank <= dy)
            ok[live[fails]] = False
            ends = (dx == _NEVER) & (dy == _NEVER)
            first = dx <= dy
            i[live] = np.where(first, ia + 1, ia)
            j[live] = np.where(first, jb, jb + 1)
            live = live[~fails & ~ends]
        return ok

    def guess(self, word: bytes) -> list[int]:
        if (whole := self.guessed.get(word)) is not None:
            return [whole]
        out, i, n, get = [], 0, len(word), self.guessed.get
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (t := get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raw = [w.encode("utf-8", "replace") for w in words]
        guesses = [self.guess(w) for w in raw]
        many = [k for k, g in enumerate(guesses) if len(g) > 1]
        if many:
            flat = np.fromiter(chain.from_iterable(guesses[k] for k in many), np.int64)
            ends = np.cumsum([len(guesses[k]) for k in many])
            inside = np.ones(len(flat) - 1, bool)
            inside[ends[:-1] - 1] = False
            of = np.repeat(np.arange(len(many)), np.diff(np.append(0, ends)))[:-1]
            at = np.flatnonzero(inside)
            for k in np.unique(of[at[~self.compatible(flat[at], flat[at + 1])]]):
                guesses[many[k]], _ = merged(raw[many[k]], self.ranks)
        return guesses


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def encode(texts: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): one row per row; an empty list for an empty or null text.

    A blank text is not empty. Strings of special tokens are ordinary text. Repeated rows are encoded each; keys may
    be null. The vocabulary (its size is checked) is broadcast; texts never leave their partition.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary(path))
    kind = dict(texts.dtypes)[key]

    def run(batches):
        import regex

        split, vocab, known = regex.compile(PATTERN).findall, shared.value, {}
        for batch in batches:
            pieces = [split(t) if t else () for t in batch.column(1).to_pylist()]
            new = {w for p in pieces for w in p if w not in known}
            if new:
                if len(known) + len(new) > REMEMBERED:
                    known = {}
                    new = {w for p in pieces for w in p}
                new = list(new)
                known.update(zip(new, vocab.encode_words(new)))
            rows = [list(chain.from_iterable(map(known.__getitem__, p))) for p in pieces]
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "ids"])

    return spread(texts.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    """(doc_id, ids): every document's token ids by byte_bpe_50k."""
    return encode(table(spark, data_dir, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
