"""Suffix-array dedup: repeated byte strings found by a hash-compared suffix sort.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.

The suffix array is cut by minimisers. Of the K-byte strings of a window of
LENGTH bytes, the one with the smallest hash is the window's anchor; equal
windows have equal anchors at equal offsets, so suffixes are compared only
within an anchor and an offset, and the windows of one anchor in one place are
one slice of text. In the first round slices meet by anchor and the first 128
bits of their SHA-256: a slice that stands elsewhere unchanged is a copy of the
earliest one, an anchor with one kind of slice needs nothing more. In the
second, the slices of anchors with several kinds meet with their bytes, and
their suffixes are sorted by a merge sort. Its comparisons find the common
extension of two suffixes by binary search over prefix polynomial hashes modulo
2**61 - 1, so each takes a logarithmic number of steps. The order is then
verified byte by byte, neighbour by neighbour; where a collision has spoilt it,
the class is sorted anew by its bytes. All but the earliest of a run of equal
suffixes are removed.

An anchor with more than HOT kinds of slices (the edges of a passage that very
many documents share) is dealt out window by window: each goes, with its bytes,
to the bucket of its own hash, and is sorted and verified there like the rest.

Nulls: a null text has no bytes; a null doc_id comes before all others. Rows of
one doc_id are taken in the order of a hash of their texts. Texts shorter than
LENGTH lose nothing; a long text is one piece of work of its group, in blocks.
A group of 2 GB or more raises OverflowError. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C
from tessera.llm.meeting import Group, bucket_slices, two_rounds

LENGTH = 100
#: Bytes of an anchor: 8 times a power of two.
K = 32
#: Kinds of slices of an anchor before its windows are dealt out singly: about half a megabyte.
HOT = 4096
#: Bytes of slices that are sorted at once.
PART = 1 << 19
U = C.U
LOW = U(0xFFFFFFFF)
#: The prime of the prefix polynomials, their base, and a number for each byte.
PRIME = U((1 << 61) - 1)
_rng = np.random.Generator(np.random.PCG64(20240601))
BASE = int(_rng.integers(1 << 40, 1 << 60))
BYTE = _rng.integers(1, (1 << 61) - 1, 256, dtype=np.uint64)

ENTRY = np.dtype([("h", "<u8"), ("d1", "<u8"), ("d2", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("kinds", "<u4")])
PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tie", "<u4"), ("at", "<i8"), ("offset", "<i4"), ("n", "<i4")])
OWN, COPY, SORT, SORT_SINGLY = 0, 1, 2, 3


def byte_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-byte strings, k being 8 times a power of two."""
    if len(data) < k:
        return np.empty(0, np.uint64)
    h, size = C.grams(data)[: len(data) - 7], 8
    while size < k:
        h = C.joined(h[:-size], h[size:])
        size *= 2
    return h


def slices(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(first, n, anchor, h, d1, d2): windows first..first+n-1 have the anchor at `anchor`, h is its hash; d1 and d2 are of all their bytes."""
    found = [[], [], [], [], [], []]
    wide = length - k + 1
    for i, j in C.blocks(off, C.BLOCK // 2):
        low = off[i]
        d = data[low : off[j]]
        if len(d) < length:
            continue
        h = byte_hashes(d, k)
        m = h & ~LOW | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < wide:
            m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
        start = off[i:j] - low
        at = C.ragged(start, np.maximum(off[i + 1 : j + 1] - off[i:j] - length + 1, 0))
        if not len(at):
            continue
        anchor = (m[at] & LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        cut = np.flatnonzero(new)
        first, n, anchor = at[cut], np.diff(np.append(cut, len(at))), anchor[cut]
        digest = C.digests(d, first, first + n + length - 1)
        for x, y in zip(found, (first + low, n, anchor + low, h[anchor], digest[:, 0], digest[:, 1]), strict=True):
            x.append(y)
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(found, kinds, strict=True))


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it, by halves of 31 bits."""
    a1, a0, b1, b0 = a >> U(31), a & U(0x7FFFFFFF), b >> U(31), b & U(0x7FFFFFFF)
    mid = a1 * b0 + a0 * b1
    return reduced((a1 * b1 << U(1)) + (mid >> U(30)) + ((mid & U(0x3FFFFFFF)) << U(31)) + a0 * b0)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> U(61))
    return np.where(x >= PRIME, x - PRIME, x)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + PRIME - b)


def powers(n: int) -> np.ndarray:
    """BASE**i modulo PRIME for i < n."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = U(pow(BASE, done, int(PRIME)))
        out[done : 2 * done] = times(out[: min(done, n - done)], step)
        done *= 2
    return out


def prefix_hashes(values: np.ndarray, power: np.ndarray) -> np.ndarray:
    """P with P[i] the sum of values[j] * BASE**j over j < i, modulo PRIME."""
    terms = times(values, power[: len(values)])
    high, low = np.cumsum(terms >> U(31), dtype=np.uint64), np.cumsum(terms & U(0x7FFFFFFF), dtype=np.uint64)
    out = np.zeros(len(values) + 1, np.uint64)
    out[1:] = reduced((high >> U(30)) + ((high & U(0x3FFFFFFF)) << U(31)) + reduced(low))
    return out


def planes(records: np.ndarray) -> bytes:
    """The records' bytes, first all first bytes, then all second ones: like bytes lie together and compress."""
    return np.ascontiguousarray(records.view(np.uint8).reshape(len(records), records.dtype.itemsize).T).tobytes()


def unplaned(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


class SuffixOrder:
    """Suffixes of `data`, compared up to `length` values by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.power = powers(len(data) + 1)
        self.p = prefix_hashes(BYTE[data], self.power)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes a[i] and b[i], by binary search."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        a, b = np.minimum(a, b), np.maximum(a, b)
        shift, pa_, pb = self.power[b - a], self.p[a], self.p[b]
        low, high = out.copy(), np.full(len(a), self.length, np.int64)
        while len(live):
            mid = (low + high + 1) >> 1
            same = times(minus(self.p[a + mid], pa_), shift) == minus(self.p[b + mid], pb)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            on = np.flatnonzero(low < high)
            if len(on) < len(live):
                out[live] = low
                live, a, b, shift, pa_, pb, low, high = (x[on] for x in (live, a, b, shift, pa_, pb, low, high))
        return out

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a[i] sorts before b[i]; equal ones do where or_equal."""
        n = self.common(a, b)
        full = n == self.length
        n = np.minimum(n, self.length - 1)
        return np.where(full, or_equal, self.data[a + n] < self.data[b + n])

    def merge_sort(self, suffix: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes within each class cut[i]..cut[i+1]: all classes' runs are merged level by level."""
        order = np.arange(len(suffix))
        size = np.diff(cut)
        begin, end = np.repeat(cut[:-1], size), np.repeat(cut[1:], size)
        place = np.arange(len(suffix))
        width = 1
        while width < size.max(initial=0):
            live = np.flatnonzero(end - begin > width)
            at = place[live]
            run = (at - begin[live]) // width
            left = run % 2 == 0
            own = begin[live] + run * width
            other = np.where(left, own + width, own - width)
            low = np.minimum(other, end[live])
            high = np.minimum(other + width, end[live])
            floor = low.copy()
            x = suffix[order[at]]
            for _ in range(width.bit_length()):
                todo = np.flatnonzero(low < high)
                if not len(todo):
                    break
                mid = (low[todo] + high[todo]) >> 1
                # an equal element of the left run comes first
                less = self.before(suffix[order[mid]], x[todo], ~left[todo])
                low[todo], high[todo] = np.where(less, mid + 1, low[todo]), np.where(less, high[todo], mid)
            to = np.minimum(own, np.where(left, own, other)) + (at - own) + (low - floor)
            fresh = order.copy()
            fresh[to] = order[at]
            order = fresh
            width *= 2
        return order

    def words(self) -> np.ndarray:
        """The 8 bytes from each place on, as numbers that sort as the bytes do."""
        return C.grams(self.data)

    def checked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether suffix a[i] is equal to b[i], and whether it is after b[i], by their bytes."""
        g, live = self.words(), np.arange(len(a))
        equal, after = np.ones(len(a), bool), np.zeros(len(a), bool)
        for at in (*range(0, self.length - 7, 8), *([max(self.length - 8, 0)] if self.length % 8 else [])):
            mask = C.FIRST[min(self.length, 8)]
            x, y = (g[a[live] + at] & mask).byteswap(), (g[b[live] + at] & mask).byteswap()
            equal[live[x != y]] = False
            after[live[x > y]] = True
            live = live[x == y]
        return equal, after

    def sorted(self, suffix: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, same): the merge sort's order, verified, and whether a suffix equals the one before it in its class."""
        order = self.merge_sort(suffix, cut)
        cls = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        near = np.flatnonzero(cls[1:] == cls[:-1])
        while True:
            s = suffix[order]
            equal, after = self.checked(s[near], s[near + 1])
            if not after.any():
                break
            for k in np.unique(cls[near[after]]).tolist():  # a collision: this class by its bytes
                own = np.arange(cut[k], cut[k + 1])
                g, mask = self.words(), C.FIRST[min(self.length, 8)]
                places = [*range(0, self.length - 7, 8), max(self.length - 8, 0)]
                order[own] = own[np.lexsort([(g[suffix[own] + p] & mask).byteswap() for p in reversed(places)])]
        same = np.zeros(len(suffix), bool)
        same[near + 1] = equal
        return order, same


def later(pieces: np.ndarray, data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of each piece (their bytes follow one another in data): whether an equal one is earlier.

    Keys are taken in parts of about PART bytes, so that the prefix hashes of
    one part only are in memory.
    """
    n = pieces["n"].astype(np.int64)
    size = n + length - 1
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    window = np.concatenate(([0], np.cumsum(n)))[:-1]
    out = np.zeros(int(n.sum()), bool)
    order = np.argsort(pieces["key"], kind="stable")
    key, upto = pieces["key"][order], np.cumsum(size[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PART, "right")))
        j = int(np.searchsorted(key, key[j - 1], "right"))
        some = order[i:j]
        if j - i > 1:
            out[C.ragged(window[some], n[some])] = _later(pieces[some], data[C.ragged(first[some], size[some])], length)
        i = j
    return out


def _later(pieces: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    n = pieces["n"].astype(np.int64)
    first = np.concatenate(([0], np.cumsum(n + length - 1)))[:-1]
    suffix = C.ragged(first, n)
    step = C.ragged(np.zeros(len(n), np.int64), n)
    own = np.repeat(np.arange(len(n)), n)
    cls = C.mix(pieces["key"][own] + C.mix((pieces["offset"][own] - step).astype(np.uint64)))
    out = np.zeros(len(suffix), bool)
    by = np.argsort(cls, kind="stable")
    alone = np.ones(len(by) + 1, bool)
    alone[1:-1] = cls[by][1:] != cls[by][:-1]
    some = by[~(alone[:-1] & alone[1:])]
    if not len(some):
        return out
    some = some[np.lexsort((pieces["at"][own[some]] + step[some], pieces["tie"][own[some]], pieces["doc"][own[some]], cls[some]))]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(cls[some])) + 1, [len(some)]))
    order, same = SuffixOrder(data, length).sorted(suffix[some], cut)
    out[some[order][same]] = True
    return out


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept): the removed runs as (start, end) byte offsets, and the bytes that stay."""

    def local(group: Group) -> tuple[np.ndarray, ...]:
        """slices, and of them: an order by anchor, digest and place; which are local copies, and the first of each kind."""
        first, n, anchor, h, d1, d2 = slices(group.data, group.off, length)
        order = np.lexsort((first, d2, d1, h))
        ho = h[order]
        new_h = np.ones(len(order), bool)
        new_h[1:] = ho[1:] != ho[:-1]
        new = new_h.copy()
        new[1:] |= (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
        copies = order[~new]
        lead = order[new]  # by anchor
        which = np.cumsum(new_h[new]) - 1 if len(order) else np.empty(0, np.int64)
        return first, n, anchor, h, d1, d2, copies, lead, which

    def entries(group: Group, buckets: int):
        found = local(group)
        first, _, _, h, d1, d2, _, lead, which = found
        starts = np.flatnonzero(np.diff(which, prepend=-1))
        e = np.zeros(len(starts), ENTRY)
        one = lead[starts]
        e["h"], e["d1"], e["d2"], e["kinds"] = h[one], d1[one], d2[one], np.diff(np.append(starts, len(lead)))
        doc = np.searchsorted(group.off, first[one], "right") - 1
        e["doc"], e["tie"] = group.ids[doc], group.ties[doc]
        b = (e["h"] % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        return found, e[order], b[order], order

    def send(group: Group, buckets: int) -> dict[int, bytes]:
        _, e, b, _ = entries(group, buckets)
        return {k: planes(e[i:j]) for k, i, j in bucket_slices(b)}

    def answer(blobs: dict[int, bytes]) -> dict[int, bytes]:
        e = np.concatenate([unplaned(x, ENTRY) for x in blobs.values()])
        several = e["kinds"] > 1
        order = np.lexsort((e["tie"], e["doc"], several, e["d2"], e["d1"], e["h"]))
        s, of_several = e[order], several[order]
        new_h = np.ones(len(s), bool)
        new_h[1:] = s["h"][1:] != s["h"][:-1]
        # kinds: digests among the entries with one; any entry with several makes the anchor one with several kinds
        new = new_h.copy()
        new[1:] |= (s["d1"][1:] != s["d1"][:-1]) | (s["d2"][1:] != s["d2"][:-1]) | (of_several[1:] != of_several[:-1])
        cut = np.flatnonzero(new_h)
        kinds = np.add.reduceat(np.where(new | of_several, s["kinds"], 0).astype(np.int64), cut)
        each = np.cumsum(new_h) - 1
        code = np.where((np.logical_or.reduceat(of_several, cut) | (kinds > 1))[each], np.where((kinds > HOT)[each], SORT_SINGLY, SORT), OWN)
        code[~new & ~of_several] = COPY
        out = np.empty(len(e), np.uint8)
        out[order] = code
        at = np.concatenate(([0], np.cumsum([len(x) // ENTRY.itemsize for x in blobs.values()])))
        return {g: out[at[i] : at[i + 1]].tobytes() for i, g in enumerate(blobs)}

    def send_again(group: Group, buckets: int, replies: dict[int, bytes]) -> dict[int, bytes]:
        (first, n, anchor, h, _, _, copies, lead, which), e, b, order = entries(group, buckets)
        code = np.empty(len(e), np.uint8)
        for k, i, j in bucket_slices(b):
            code[order[i:j]] = np.frombuffer(replies[k], np.uint8)
        of = code[which] if len(lead) else np.empty(0, np.uint8)
        gone = np.concatenate((copies, lead[of == COPY]))
        together, singly = lead[of == SORT], lead[of == SORT_SINGLY]
        # of equal windows here, the earliest goes on
        w = np.sort(C.ragged(first[singly], n[singly]))
        wh = window_hashes(group.data, w, length)
        number, one = C.numbered(group.data, w, w + length, wh)
        again = one[number] != np.arange(len(w))
        gone_w, w, wh = w[again], w[~again], wh[~again]
        pieces = np.zeros(len(together) + len(w), PIECE)
        pieces["key"] = np.concatenate((h[together], wh))
        pieces["at"] = np.concatenate((first[together], w))
        pieces["offset"] = np.concatenate((anchor[together] - first[together], np.zeros(len(w), np.int64)))
        pieces["n"] = np.concatenate((n[together], np.ones(len(w), np.int64)))
        b = (pieces["key"] % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        pieces, b = pieces[order], b[order]
        doc = np.searchsorted(group.off, pieces["at"], "right") - 1
        pieces["doc"], pieces["tie"] = group.ids[doc], group.ties[doc]
        at, count = pieces["at"], pieces["n"].astype(np.int64)
        out = {k: b"".join((np.int64(j - i).tobytes(), planes(pieces[i:j]), group.data[C.ragged(at[i:j], count[i:j] + length - 1)].tobytes())) for k, i, j in bucket_slices(b)}
        state = (np.concatenate((first[gone], gone_w)), np.concatenate((n[gone], np.ones(len(gone_w), np.int64))), at, count, b)
        out[-1] = b"".join((np.array([len(state[0]), len(at)], np.int64).tobytes(), *(x.astype(np.int64).tobytes() for x in state)))
        return out

    def answer_again(blobs: dict[int, bytes]) -> dict[int, bytes]:
        pieces, texts = [], []
        for x in blobs.values():
            end = 8 + int(np.frombuffer(x, np.int64, 1)[0]) * PIECE.itemsize
            pieces.append(unplaned(x[8:end], PIECE))
            texts.append(np.frombuffer(x, np.uint8, -1, end))
        out = later(np.concatenate(pieces), np.concatenate(texts), length)
        at = np.concatenate(([0], np.cumsum([int(p["n"].sum()) for p in pieces])))
        return {g: np.packbits(out[at[i] : at[i + 1]]).tobytes() for i, g in enumerate(blobs)}

    def finish(group: Group, buckets: int, replies: dict[int, bytes]) -> pa.Table:
        size, docs_ = len(group.data), len(group.off) - 1
        state = np.frombuffer(replies.get(-1, b""), np.int64)
        windows = [np.empty(0, np.int64)]
        if len(state):
            k, m = state[:2].tolist()
            first, n, at, count, b = np.split(state[2:], np.cumsum([k, k, m, m]))
            windows.append(C.ragged(first, n))
            for x, i, j in bucket_slices(b):
                w = C.ragged(at[i:j], count[i:j])
                windows.append(w[np.unpackbits(np.frombuffer(replies[x], np.uint8), count=len(w)).astype(bool)])
        removed = C.cover(np.concatenate(windows), length, size)
        edge = np.zeros(size + 1, bool)
        edge[group.off] = True
        start = np.flatnonzero(removed & (~np.append(False, removed[:-1]) | edge[:-1]))
        end = np.flatnonzero(removed & (~np.append(removed[1:], False) | edge[1:])) + 1
        doc = np.searchsorted(group.off, start, "right") - 1
        runs = pa.ListArray.from_arrays(pa.array(C.narrow(np.searchsorted(doc, np.arange(docs_ + 1)))), pa.StructArray.from_arrays([pa.array(start - group.off[doc]), pa.array(end - group.off[doc])], ["start", "end"]))
        off = C.narrow(np.concatenate(([0], np.cumsum(C.sums(~removed, group.off)))))
        kept = pa.BinaryArray.from_buffers(pa.binary(), docs_, [None, pa.py_buffer(off), pa.py_buffer(group.data[~removed].copy())])
        return pa.table([group.doc_id, pa.array(np.diff(group.off)), runs, kept], ["doc_id", "n_bytes", "removed", "kept"])

    return two_rounds(docs, send, answer, send_again, answer_again, finish, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def window_hashes(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of data[at:at+length], by doubling; at ascends."""
    out = np.empty(len(at), np.uint64)
    size = 8
    while 2 * size <= length:
        size *= 2
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, at[i] + C.BLOCK)))
        low = at[i]
        h = byte_hashes(data[low : at[j - 1] + length], size)
        out[i:j] = C.joined(h[at[i:j] - low], h[at[i:j] - low + length - size])
        i = j
    return out
