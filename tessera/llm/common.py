"""Vectorised text primitives over Arrow buffers, shared by the operators of this subpackage.

Texts arrive as Arrow string columns whose values lie end to end in one byte
buffer, so numpy can tokenise and hash a whole batch without a Python object
per word. Work goes in blocks of about `BLOCK` bytes to keep memory flat; a
longer text is a block of its own.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash

BLOCK = 2 << 20
U = np.uint64
#: The separators of words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Key of the hashes.
SEED = U(0x5D1B7C2E90A3F864)
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Longer spans are hashed and compared one by one.
LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what a and b, hashes of two neighbours, stand for."""
    x = a * U(0x9E3779B97F4A7C15)
    x += b ^ SEED
    return mix(x)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values of h, joined by doubling: no polynomial, so no structured texts collide."""
    out, upto, size, n = None, 0, 1, max(0, len(h) - k + 1)
    while n:
        if k & size:
            out = h if out is None else joined(out[: len(h) - upto], h[upto:])
            upto += size
        if upto == k:
            return out[:n]
        h = joined(h[:-size], h[size:])
        size *= 2
    return np.empty(0, np.uint64)


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number, zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed 64-bit hash of each data[start:end]: 8 bytes at a time, longer ones than LONG by XXH3."""
    size = ends - starts
    h = mix(size.astype(np.uint64) ^ SEED)
    if not len(h):
        return h
    g = grams(data)
    live, at, left = slice(None), starts, np.minimum(size, LONG)
    while len(at):
        h[live] = mix(h[live] ^ (g[at] & FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    far = np.flatnonzero(size > LONG)
    if len(far):
        raw = memoryview(data)
        h[far] = [xxhash.xxh3_64_intdigest(raw[a:b], seed=int(SEED)) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return h


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    """Whether data[start:end] holds the same bytes as data[other:other_end]."""
    size = ends - starts
    same = size == other_ends - others
    live = np.flatnonzero(same & (size > 0) & (starts != others))
    if not len(live):
        return same
    g = grams(data)
    for i in live[size[live] > LONG].tolist():
        same[i] = data[starts[i] : ends[i]].tobytes() == data[others[i] : other_ends[i]].tobytes()
    live = live[size[live] <= LONG]
    a, b, left = starts[live], others[live], size[live]
    while len(live):
        alike = ((g[a] ^ g[b]) & FIRST[np.minimum(left, 8)]) == 0
        same[live[~alike]] = False
        on = np.flatnonzero(alike & (left > 8))
        live, a, b, left = live[on], a[on] + 8, b[on] + 8, left[on] - 8
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number, first): equal spans, and only those, have the same number; first: one span of each number.

    Spans meet by hash and are then compared by their bytes; where a hash holds
    several kinds, they are told apart by the bytes themselves.
    """
    h = span_hashes(data, starts, ends) if h is None else h
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    odd = np.flatnonzero(~equal_spans(data, starts, ends, starts[first][number], ends[first][number]))
    if len(odd):
        kinds: dict[bytes, int] = {}
        found = [kinds.setdefault(data[starts[i] : ends[i]].tobytes(), len(kinds)) for i in odd.tolist()]
        number[odd] = len(first) + np.array(found)
        first = np.concatenate((first, odd[np.unique(found, return_index=True)[1]]))
    return number, first


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, 2) numbers: the first 128 bits of each span's SHA-256."""
    raw = memoryview(np.ascontiguousarray(data))
    made = b"".join([sha256(raw[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, "<u8").reshape(-1, 2) if made else np.empty((0, 2), np.uint64)


def narrow(off: np.ndarray) -> np.ndarray:
    """Arrow's 32-bit offsets; an error where they don't hold them."""
    if len(off) and off[-1] >= 1 << 31:
        raise OverflowError("the texts of one group take 2 GB or more")
    return off.astype(np.int32)


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty. offsets[0] is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK):
    """(first, last) row ranges of about `most` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, woff): byte spans of the words, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, bool)
    np.logical_not(separator[data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def tidy(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, woff) of the texts' words with one space after each: a run of words is one span."""
    starts, ends, woff = words(data, off)
    size = ends - starts
    inside = ~SEPARATOR[data]
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[inside]
    begin = np.cumsum(size + 1) - size - 1
    return out, begin, begin + size, woff


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of all the spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of values[off[i]:off[i+1]] for each i, empty spans included."""
    c = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def owners(off: np.ndarray) -> np.ndarray:
    """For each element its span's number."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def cover(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Mask of 0..n-1 covered by the spans [start, start + length)."""
    if not len(starts):
        return np.zeros(n, bool)
    edges = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(edges[:n]) > 0
