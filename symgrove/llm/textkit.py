"""Vectorised text primitives shared by the corpus operators.

All of it works on the UTF-8 buffer of an Arrow string column, so a batch of
documents is tokenised and hashed by a handful of numpy passes instead of a
Python loop over words.

A *word* is a maximal run of characters that are ASCII letters or digits, or
non-ASCII characters outside U+0080-U+00BF, U+2000-U+206F and U+3000-U+303F
(punctuation and spaces), after Unicode lower-casing.  ``WORD_RE_SQL`` is the
same definition as a regular expression for RE2 dialects.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_RE_SQL = r"[0-9a-z\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"
SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = True
_IS_WORD[ord("a") : ord("z") + 1] = True
_IS_WORD[0x80:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for i, base in enumerate((_P, _PINV)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _powers[i] = np.cumprod(t, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def string_array(column) -> pa.Array:
    """One contiguous string array, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array; offsets index the bytes."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system, which workers that are used again would keep."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES):
    """(first, last) row ranges of at most ``max_bytes`` of text, or one row."""
    _, offs = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi
    release()


def whole_groups(batches, keys: list[str], rows: int = 1 << 14):
    """Tables of a partition sorted by ``keys`` that end where a group ends."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        t = pa.concat_tables(held)
        same = np.ones(t.num_rows, bool)
        for k in keys:
            c = t[k].to_numpy()
            same &= c == c[-1]
        first = int(same.argmax())  # the last group may go on in the next batch
        if first:
            yield t.slice(0, first)
        held = [t.slice(first)]
    if held:
        yield pa.concat_tables(held)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of lower-cased text."""
    w = _IS_WORD[data]
    n = len(data)
    if n and data.max() >= 0x80:
        for i in (0xC2, 0xE2, 0xE3):
            at = np.flatnonzero(data == i)
            if not len(at):
                continue
            second = data[np.minimum(at + 1, n - 1)]
            third = data[np.minimum(at + 2, n - 1)]
            if i == 0xC2:
                w[at] = w[np.minimum(at + 1, n - 1)] = False
                continue
            sep = second == 0x80
            if i == 0xE2:
                sep |= (second == 0x81) & (third <= 0xAF)
            at = at[sep]
            w[at] = w[at + 1] = w[at + 2] = False
    cut = offs[:-1][offs[:-1] < n]
    prev = np.empty(n, bool)
    prev[:1] = False
    prev[1:] = w[:-1]
    prev[cut] = False
    starts = np.flatnonzero(w & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1:] = False
    nxt[:-1] = w[1:]
    nxt[cut[cut > 0] - 1] = False
    return starts, np.flatnonzero(w & ~nxt) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, from one prefix sum over the buffer."""
    p, inv = _power_tables(len(data))
    s = np.empty(len(data) + 1, np.uint64)
    s[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=s[1:])
    return mix((s[ends] - s[starts]) * inv[starts])


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a lower-cased column: (hashes, first, starts, ends, data).

    ``first`` has one more entry than there are rows: row i owns the words
    first[i] to first[i + 1].
    """
    data, offs = buffers(column)
    starts, ends = word_spans(data, offs)
    first = np.searchsorted(starts, offs)
    return span_hashes(data, starts, ends), first, starts, ends, data


_C = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles: (hashes, position of their first word, first).

    A row of 1 to k - 1 words has one shingle of all its words.
    """
    n = len(h)
    counts = np.diff(first)
    per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per)])
    pos = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], per)
    acc = np.zeros(len(pos), np.uint64)
    end = np.repeat(first[1:], per)
    short = bool((counts[counts > 0] < k).any())
    for j in range(k):
        if short:
            ok = pos + j < end
            acc[ok] += h[pos[ok] + j] * _C[j]
        else:
            acc += h[pos + j] * _C[j] if n else 0
    return mix(acc), pos, bounds


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
