"""Vectorised words, shingles and fingerprints over whole Arrow columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. Nothing here loops over words in Python, and nothing depends
on the interpreter's hash seed: equal words have equal hashes in every process.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from those of its two parts. It isn't linear in either, so no pattern of words cancels out."""
    return mix(mix(a) + b)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = (_U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93))
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U)
LONG = 4096  # bytes of a word from which it is hashed by itself


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, zeros beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, np.dtype("<u8"), padded.tobytes(), strides=(1,))[: len(data)]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def views(col: pa.ChunkedArray, kind: type) -> Iterator[np.ndarray]:
    """The values of a binary column without nulls as arrays, read in place; a scalar of it would be a copy."""
    for chunk in col.chunks:
        data, offs = bytes_of(chunk)
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            yield data[a:b].view(kind)


def blocks(batch: pa.RecordBatch, text: str = "text", most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `most` bytes of text each (or one longer document)."""
    _, o = bytes_of(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(o, o[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def cuts(data: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that end before a byte of the table gap or at the end of a document, never inside a word."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + PIECE, n)
        if hi < n:
            end = int(offs[np.searchsorted(offs, hi)])
            step = hi
            while step < end:
                found = np.flatnonzero(gap[data[step : step + 65536]])
                if len(found):
                    end = min(end, step + int(found[0]))
                    break
                step += 65536
            hi = end
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray, lower: bool, sides: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of all words for each side, first): document i has words first[i]:first[i + 1]."""
    hashes, starts_all = [[] for _ in range(sides)], []
    for lo, hi in cuts(data, offs, _SPACE):
        part = data[lo:hi]
        space = _SPACE[part]
        begin = ~space
        begin[1:] &= space[:-1]
        inner = offs[(offs >= lo) & (offs < hi)] - lo
        begin[inner] = ~space[inner]
        at = np.flatnonzero(begin)
        if len(at):
            kept = ~space
            chars = part[kept]
            rank = np.cumsum(kept) - 1
            first = rank[at]
            for s, h in enumerate(_word_hashes(_LOWER[chars] if lower else chars, first, np.diff(np.append(first, len(chars))), sides)):
                hashes[s].append(h)
            starts_all.append(at + lo)
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    return [np.concatenate(h) if h else np.zeros(0, _U) for h in hashes], np.searchsorted(starts, offs)


def _word_hashes(chars: np.ndarray, first: np.ndarray, lens: np.ndarray, sides: int) -> list[np.ndarray]:
    """Hashes of words by eight bytes at a time: words of one length up to eight bytes never collide, others by chance only."""
    out, view = [mix(lens.astype(_U) + _SEED[s]) for s in range(sides)], lanes(chars)
    at, lane = np.flatnonzero(lens <= LONG), 0
    while len(at):
        v = view[first[at] + lane] & _MASK[np.minimum(lens[at] - lane, 8)]
        for h in out:
            h[at] = mix(h[at] ^ v)
        lane += 8
        at = at[lens[at] > lane]
    for i in np.flatnonzero(lens > LONG).tolist():
        whole = hashlib.blake2b(chars[first[i] : first[i] + lens[i]].tobytes(), digest_size=16).digest()
        for s, h in enumerate(out):
            h[i] = np.frombuffer(whole, _U)[s]
    return out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by the place of the first; those that cross documents are there too. Parts of 1, 2, 4, ...
    words are joined, so the cost grows with the logarithm of k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out, done, width, g = None, 0, 1, h
    while width <= k:
        if k & width:
            out = g[:n] if out is None else join(out, g[done : done + n])
            done += width
        if 2 * width <= k:
            g = join(g[:-width], g[width:])
        width *= 2
    return mix(out + _U(k))


def shingle_sets(h: np.ndarray, first: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each document its sorted distinct k-word shingles; with fewer words the whole sequence is one; without words none."""
    g, out = grams(h, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(grams(h[a:b], b - a) if b > a else np.zeros(0, _U))
    return out


def prints(h: np.ndarray) -> int:
    """Order-dependent 64-bit fingerprint of a sequence of hashes: the sum of one hash of each with its place."""
    return int(mix(mix(h ^ mix(np.arange(len(h), dtype=_U))).sum(dtype=_U, keepdims=True) + _U(len(h)))[0]) if len(h) else 0


def longs(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def binary(parts: list[np.ndarray]) -> pa.Array:
    """One binary value of each array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())
