"""Substring dedup by fixed-block anchors.

The reference blocks of a text are its non-overlapping runs of BLOCK words,
counted from its start. Every rolling window of BLOCK words, of every text,
probes the index of those blocks; BLOCK is (WINDOW + 1) // 2, so a window of
WINDOW words that is found twice holds a whole block in each of its places'
alignments, and the other place's window hits it. Hits are extended to all
windows of WINDOW words around them, and those found twice are joined to
maximal exact repeats.

A probe is a hash of 40 bits within its bucket and only selects candidates.
Equal windows of one group of documents are found by their bytes; windows of
different groups are compared by the first 128 bits of the SHA-256 of their
words. The words of a text are what stands between the bytes 0x20 and 0x09 to
0x0D.

Nulls: a null text has no words. Texts of fewer than WINDOW words lose nothing;
a long text is one piece of work of its group, in blocks. Rows of one doc_id are
documents of their own, equal rows too. A group of 2 GB or more raises
OverflowError. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common as C
from tessera.llm.meeting import Group, bucket_slices, two_rounds

WINDOW = 35
U = C.U


class Words:
    """The words of a group's texts, one space after each: spans, each text's first word, hashes."""

    def __init__(self, group: Group):
        data, starts, ends, hashes, woff = [], [], [], [], [np.zeros(1, np.int64)]
        n = size = 0
        for i, j in C.blocks(group.off):
            low = group.off[i]
            d, s, e, w = C.tidy(group.data[low : group.off[j]], group.off[i : j + 1] - low)
            data.append(d)
            starts.append(s + size)
            ends.append(e + size)
            hashes.append(C.span_hashes(d, s, e))
            woff.append(w[1:] + n)
            n += len(s)
            size += len(d)
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.data, self.starts, self.ends, self.hashes, self.woff = join(data, np.uint8), join(starts, np.int64), join(ends, np.int64), join(hashes, np.uint64), np.concatenate(woff)

    def windows(self, k: int, shortest: int) -> np.ndarray:
        """The starts of all runs of k words within a text of `shortest` words or more."""
        size = np.diff(self.woff)
        count = np.where(size >= shortest, np.maximum(size - k + 1, 0), 0)
        return C.ragged(self.woff[:-1], count)

    def hash(self, at: np.ndarray, k: int) -> np.ndarray:
        return C.rolling(self.hashes, k)[at]


def keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """bucket << 40 | 40 bits of the hash."""
    return ((h & U(0xFFFFFF)) % U(buckets)) << U(40) | h >> U(24)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text's other words, joined by one space."""
    block = (window + 1) // 2

    def probes(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        at = w.windows(block, window)
        return at, keys(w.hash(at, block), buckets)

    def send(group: Group, buckets: int) -> dict[int, bytes]:
        w = Words(group)
        at, key = probes(w, buckets)
        first = w.woff[:-1][np.searchsorted(w.woff, at, "right") - 1] if len(at) else at
        reference = ((at - first) % block == 0).astype(np.uint64)
        both = np.sort(key << U(1) | reference)
        key = both >> U(1)
        new = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.empty(0, np.int64)
        distinct, count = key[new], np.diff(np.append(new, len(key)))
        indexed = np.maximum.reduceat(both & U(1), new).astype(bool) if len(new) else np.empty(0, bool)
        out = {}
        for b, i, j in bucket_slices((distinct >> U(40)).astype(np.int64)):
            planes = np.ascontiguousarray(distinct[i:j].view(np.uint8).reshape(-1, 8)[:, :5].T)
            out[b] = b"".join((np.int64(j - i).tobytes(), np.packbits(indexed[i:j]).tobytes(), np.packbits(count[i:j] > 1).tobytes(), planes.tobytes()))
        return out

    def answer(blobs: dict[int, bytes]) -> dict[int, bytes]:
        values, flags = [], []
        for blob in blobs.values():
            raw = np.frombuffer(blob, np.uint8)
            n = int(np.frombuffer(blob, np.int64, 1)[0])
            bits = -(-n // 8)
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :5] = raw[8 + 2 * bits :].reshape(5, n).T
            values.append(wide.view(np.uint64).ravel())
            flags.append(np.unpackbits(raw[8 : 8 + bits], count=n).astype(np.uint64) | np.unpackbits(raw[8 + bits : 8 + 2 * bits], count=n).astype(np.uint64) << U(1))
        both = np.sort(np.concatenate(values) << U(2) | np.concatenate(flags))
        v = both >> U(2)
        new = np.flatnonzero(np.diff(v, prepend=~v[:1]))
        any_ = np.bitwise_or.reduceat(both & U(3), new)
        hit = v[new][((any_ & U(1)) > 0) & ((np.diff(np.append(new, len(v))) > 1) | (any_ & U(2) > 0))]
        return {g: np.packbits(np.isin(x, hit, assume_unique=True)).tobytes() for g, x in zip(blobs, values, strict=True)}

    def candidates(w: Words, buckets: int, replies: dict[int, bytes]) -> np.ndarray:
        """The starts of the windows that hold a hit."""
        at, key = probes(w, buckets)
        distinct = np.unique(key)
        hit = np.zeros(len(distinct), bool)
        for b, i, j in bucket_slices((distinct >> U(40)).astype(np.int64)):
            hit[i:j] = np.unpackbits(np.frombuffer(replies[b], np.uint8), count=j - i).astype(bool)
        hits = at[np.isin(key, distinct[hit])]
        near = C.cover(np.maximum(hits - (window - block), 0), window - block + 1, len(w.hashes)) if len(hits) else np.zeros(len(w.hashes), bool)
        all_ = w.windows(window, window)
        return all_[near[all_]]

    def entries(w: Words, at: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """Of the distinct windows here, by bucket: bucket, a start, count; and each window's number among them."""
        h = w.hash(at, window)
        number, first = C.numbered(w.data, w.starts[at], w.ends[at + window - 1], h)
        b = ((h[first] & U(0xFFFFFF)) % U(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return b[order], at[first[order]], np.bincount(number, minlength=len(first))[order], place[number]

    def send_again(group: Group, buckets: int, replies: dict[int, bytes]) -> dict[int, bytes]:
        w = Words(group)
        at = candidates(w, buckets, replies)
        b, one, count, _ = entries(w, at, buckets)
        digest = C.digests(w.data, w.starts[one], w.ends[one + window - 1])
        out = {k: b"".join((np.int64(j - i).tobytes(), digest[i:j].T.tobytes(), (count[i:j] > 1).tobytes())) for k, i, j in bucket_slices(b)}
        breaks = np.flatnonzero(np.diff(at) != 1) + 1
        runs = np.stack((at[np.concatenate(([0], breaks))], np.diff(np.concatenate(([0], breaks, [len(at)]))))) if len(at) else np.empty((2, 0), np.int64)
        out[-1] = runs.astype(np.int64).tobytes()
        return out

    def answer_again(blobs: dict[int, bytes]) -> dict[int, bytes]:
        sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs.values()]
        part = lambda kind, at: np.concatenate([np.frombuffer(x, kind, n, 8 + at * n) for x, n in zip(blobs.values(), sizes, strict=True)])
        d1, d2, many = part(np.uint64, 0), part(np.uint64, 8), part(bool, 16)
        order = np.lexsort((d2, d1))
        same = (d1[order][1:] == d1[order][:-1]) & (d2[order][1:] == d2[order][:-1])
        again = np.empty(len(d1), bool)
        again[order] = np.append(same, False) | np.insert(same, 0, False)
        again |= many
        cut = np.concatenate(([0], np.cumsum(sizes)))
        return {g: np.packbits(again[cut[i] : cut[i + 1]]).tobytes() for i, g in enumerate(blobs)}

    def finish(group: Group, buckets: int, replies: dict[int, bytes]) -> pa.Table:
        w = Words(group)
        runs = np.frombuffer(replies.get(-1, b""), np.int64).reshape(2, -1)
        at = C.ragged(runs[0], runs[1])
        b, _, _, number = entries(w, at, buckets)
        again = np.zeros(len(b), bool)
        for k, i, j in bucket_slices(b):
            again[i:j] = np.unpackbits(np.frombuffer(replies[k], np.uint8), count=j - i).astype(bool)
        removed = C.cover(at[again[number]], window, len(w.hashes))
        kept = np.flatnonzero(~removed)
        doc = C.owners(w.woff)[kept]
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.empty(0, bool)
        room = w.ends[kept] - w.starts[kept] + ~last  # a word, and the space after it
        out = w.data[C.ragged(w.starts[kept], room)]
        off = C.narrow(np.concatenate(([0], np.cumsum(np.bincount(doc, room, len(group.off) - 1)))))
        text = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(out))
        return pa.table([group.doc_id, pa.array(np.diff(w.woff)), pa.array(C.sums(removed, w.woff)), text], ["doc_id", "n_words", "n_removed", "kept"])

    return two_rounds(docs, send, answer, send_again, answer_again, finish, "doc_id long, n_words long, n_removed long, kept string")
