"""Splitting into words on Arrow arrays, for operators that go on in Arrow batches: the same words as functions.text.tokens.

Texts are split by looking up one table and comparing neighbours, on whole batches: no regular expression runs and no
Python string is made per word. Only texts with more than ASCII pass through lower-casing and NFKD one by one.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time; a longer text is split alone, as a whole.
PIECE = 1 << 22
_GONE = 1


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point of folded text: itself if a-z0-9 (capitals as small), _GONE for a combining mark, else 0."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789":
        table[c] = c
    table[[c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c))]] = _GONE  # none stands beyond
    return table


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all texts, where each begins and the last ends); null texts are empty."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def _cut(kinds: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """The words of texts given by their kinds, text i being kinds[ends[i]:ends[i + 1]]."""
    inside = kinds != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = ends[1:-1]
    borders = borders[(borders > 0) & (borders < len(kinds))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts = np.flatnonzero(first)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(last) - starts + 1, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kinds[inside]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, ends).astype(np.int32)), words)


@lru_cache(maxsize=1)
def _ascii() -> np.ndarray:
    table = _kinds()[:256].copy()
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


def split_words(texts: pa.Array, fold: bool = True) -> pa.ListArray:
    """list<string> of the words of each text, in order; none for a null text. Without fold accents are kept, and separate words."""
    texts = pc.fill_null(texts, "")
    raw, ends = bytes_of(texts)
    high = np.flatnonzero(raw >= 0x80)
    if not len(high):
        return _cut(_ascii()[raw], ends)
    other = distinct(np.searchsorted(ends, high, "right") - 1)
    plain = np.setdiff1d(np.arange(len(texts)), other)
    folded = [unicodedata.normalize("NFKD", t.lower()) if fold else t.lower() for t in texts.take(pa.array(other)).to_pylist()]
    kinds = _kinds()[np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not fold:
        kinds[kinds == _GONE] = 0
    stays = kinds != _GONE
    gone = np.flatnonzero(~stays)
    at = np.cumsum([0, *map(len, folded)])
    found = _cut(kinds[stays] if len(gone) else kinds, at - np.searchsorted(gone, at))
    if not len(plain):
        return found
    raw, ends = bytes_of(texts.take(pa.array(plain)))
    both = pa.concat_arrays([_cut(_ascii()[raw], ends), found])
    place = np.empty(len(texts), np.int64)
    place[plain], place[other] = np.arange(len(plain)), len(plain) + np.arange(len(other))
    return both.take(pa.array(place))


def pieces(batch: pa.RecordBatch, text: str, room: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about room (or PIECE) bytes of text, a single long text being a slice of its own."""
    room = room or PIECE
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        stop = max(int(np.searchsorted(size, done + room, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting whole arrays is what numpy does fastest."""
    out = np.sort(numbers)
    return out[np.append(True, out[1:] != out[:-1])] if len(out) else out


def coded(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(where each text's words begin and the last end, number of each word, the different words)."""
    ends = words.offsets.to_numpy().astype(np.int64)
    flat = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    return ends - ends[0], flat.indices.to_numpy().astype(np.int64), flat.dictionary


#: Powers of an odd number, for the places of a word's characters; a longer word goes through them again, mixed with its part.
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: pa.StringArray) -> np.ndarray:
    """64-bit hash of each word, the same everywhere; 0 for an empty one."""
    raw, ends = bytes_of(words)
    if not len(raw):
        return np.zeros(len(words), np.int64)
    sizes = np.diff(ends)
    place = np.arange(len(raw)) - np.repeat(ends[:-1], sizes)
    parts = raw.astype(np.uint64) * _POWERS[place & 63]
    if (long := place >= 64).any():
        parts[long] = mixed(parts[long] + (place[long] >> 6).astype(np.uint64) * _POWERS[1])
    total = np.append(np.uint64(0), np.cumsum(parts))
    out = total[ends[1:]] - total[ends[:-1]]
    return mixed(np.where(sizes > 0, out + sizes.astype(np.uint64) * _POWERS[0], np.uint64(0))).view(np.int64)
