"""Packing documents into training sequences: vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, on segments and on loss-bearing tokens. Each
example is a vector of the three, in units of the limits; the next one placed
is the one whose vector has the largest dot product with what the open sequence
has left (Panigrahy et al., 2011), among those that fit. Pieces of a whole
sequence's length are cut off first. Where cutting is allowed and none of the
rest fits, the last room is filled by the front of the best example, and what
remains at the end is cut at powers of two, so that nothing is padded.

Every task packs the rows it scans, batch by batch, so nothing is shuffled and
a batch is all that is in memory; sequences do not cross batches. sequence_id
is made of the partition's number and a count within it: the same for the same
table under the same split of its files and the same size of Arrow batches.

Every token of a document bears loss, so there the limits on tokens and on
segments shape the sequences, and that on loss-bearing tokens is idle. In
conversations (`pack_conversations`) the assistant's turns bear loss, and a
sequence has room for LOSS_SHARE of its tokens only, so all three do.

Texts are tokenised whole. The ids are those of the `tokenizers` file
byte_bpe_50k.json; they are made from the same vocabulary's rank file, which
takes a sixth of the time (a test holds the two against each other).

Nulls: a null text is empty and still has its end token. Rows of one doc_id are
packed each for itself. A long text is cut into whole sequences. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cluster import bounded_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
END = 1
TOKENS, SEGMENTS, LOSS_TOKENS = 2048, 32, 2048
#: Of a sequence of conversations, the part that may bear loss.
LOSS_SHARE = 0.75
#: Turns of a conversation that are packed together.
TURNS = 256
#: Examples weighed against each other at once.
WINDOW = 512


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str):
    """The encoder of a rank file, kept by a worker for all its tasks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(texts: list[str | None], path: str | None = None) -> list[np.ndarray]:
    """The ids of each whole text, without END; a special token's string is that token."""
    encode = encoder(path or vocabulary_path()).encode_to_numpy
    return [encode(t, allowed_special="all") if t else np.empty(0, np.uint32) for t in texts]


@dataclass(frozen=True)
class Limits:
    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss_tokens: int = LOSS_TOKENS


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(lengths: np.ndarray, loss: np.ndarray | None = None, limits: Limits = Limits(), cut: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Pieces (example, start, length, sequence, offset), sequences counted from 0.

    loss: loss-bearing tokens of each example, all of its tokens if None; a cut
    example bears loss in proportion, rounded up. Without cutting, an example
    above a limit raises ValueError. An example of no tokens gets no piece.
    """
    lengths = np.asarray(lengths, np.int64)
    share = np.ones(len(lengths)) if loss is None else np.divide(loss, lengths, out=np.zeros(len(lengths)), where=lengths > 0)
    bears = lambda i, n: int(np.ceil(share[i] * n - 1e-9))
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    begin = np.zeros(len(lengths), np.int64)
    whole = limits.tokens if loss is None and limits.loss_tokens >= limits.tokens else 0
    if not cut and len(lengths) and (lengths.max() > limits.tokens or np.ceil(share * lengths).max() > limits.loss_tokens or limits.segments < 1):
        raise ValueError("an example is above a limit and must not be cut")
    if cut and whole:
        for i in np.flatnonzero(lengths >= whole).tolist():
            while lengths[i] - begin[i] >= whole:
                out.append((i, int(begin[i]), whole, sequence, 0))
                begin[i] += whole
                sequence += 1
    items = np.flatnonzero(lengths - begin > 0)
    for at in range(0, len(items), WINDOW):
        ids = items[at : at + WINDOW]
        need = np.stack((lengths[ids] - begin[ids], np.ones(len(ids)), np.ceil(share[ids] * (lengths[ids] - begin[ids]) - 1e-9)), 1)
        scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss_tokens])
        vectors, open_ = need * scale, np.ones(len(ids), bool)
        remaining = len(ids)
        while remaining:
            left = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
            row: list[tuple[int, int, int]] = []
            offset = 0
            while remaining and left[0] >= 1 and left[1] >= 1:
                score = vectors @ (left * scale)
                score[~open_ | (need > left).any(1)] = -1.0
                best = int(score.argmax())
                if score[best] >= 0:
                    n = int(need[best, 0])
                    row.append((int(ids[best]), int(begin[ids[best]]), n))
                    left -= need[best]
                    offset += n
                    open_[best] = False
                    remaining -= 1
                    continue
                if not cut:
                    break
                # the front of an example fills the room
                score = np.where(open_, vectors @ (left * scale), -1.0)
                best = int(score.argmax())
                i = int(ids[best])
                room = int(min(left[0], left[2] // share[i] if share[i] > 0 else left[0], need[best, 0]))
                while room > 0 and bears(i, room) > left[2]:
                    room -= 1
                if room < 1:
                    break
                row.append((i, int(begin[i]), room))
                begin[i] += room
                left -= (room, 1, bears(i, room))
                offset += room
                rest = int(lengths[i] - begin[i])
                if rest:
                    need[best] = (rest, 1, bears(i, rest))
                    vectors[best] = need[best] * scale
                else:
                    open_[best] = False
                    remaining -= 1
            if not row:
                raise ValueError("no example fits an empty sequence")
            size = sum(n for _, _, n in row)
            sizes = [size] if size == limits.tokens or not cut else powers_of_two(size)
            for length in sizes:
                offset = 0
                while offset < length:
                    i, start, n = row[0]
                    take = min(n, length - offset)
                    out.append((i, start, take, sequence, offset))
                    offset += take
                    row[0] = (i, start + take, n - take)
                    if take == n:
                        row.pop(0)
                sequence += 1
    return out


PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def pack_documents(docs: DataFrame, path: str | None = None, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id and PIECE's columns, and the piece's ids if asked for."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}{', ids array<int>' * with_ids}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        end = np.array([END], np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            made = token_ids(batch.column(1).to_pylist(), path)
            ids = np.concatenate([x for doc in made for x in (doc, end)]).astype("<u4")
            lengths = np.fromiter(map(len, made), np.int64, len(made)) + 1
            ioff = np.concatenate(([0], np.cumsum(lengths)))
            pieces = np.array(pack(lengths, limits=limits), np.int64).reshape(-1, 5)
            raw = ids.tobytes()
            at = ioff[pieces[:, 0]] + pieces[:, 1]
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), pieces[:, 2].tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(pieces[:, 0])), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(lengths[pieces[:, 0]]), pa.array(first + pieces[:, 3]), pa.array(pieces[:, 4])]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(pieces[:, 2]))).astype(np.int32)), pa.array(ids[C.ragged(at, pieces[:, 2])].astype(np.int32))))
            first += int(pieces[:, 3].max(initial=-1)) + 1
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(each, schema)


def pack_conversations(turns: DataFrame, path: str | None = None, limits: Limits = Limits(loss_tokens=int(TOKENS * LOSS_SHARE)), trained: str = "assistant") -> DataFrame:
    """(conv_id, length, loss_tokens, sequence_id, offset) for (conv_id, turn, role, text): whole conversations under three limits.

    A conversation's tokens are those of its turns in order, each with END; the
    turns of the role `trained` bear loss. One that is above a limit by itself is
    cut into conversations of their own at the last turn that fits, and a turn
    that is longer than a sequence is cut into parts. So are TURNS turns and the
    next ones: no task holds more of a conversation. Turns of one number are in the
    order of their role and text; a null text is empty; turns without an id are
    conversations of their own, equal ones together.
    """
    bounded_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    key = F.struct(F.col("turn"), F.col("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    part = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.floor(F.col("turn") / TURNS))
    whole = turns.groupBy("conv_id", part.alias("part")).agg(F.sort_array(F.collect_list(key)).alias("turns")).select("conv_id", "turns")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            owner, lengths, loss = [], [], []
            for i, said in enumerate(batch.column(1).to_pylist()):
                n = bears = 0
                for turn, ids in zip(said, token_ids([t["text"] for t in said], path), strict=True):
                    left, of_loss = len(ids) + 1, turn["role"] == trained
                    most = min(limits.tokens, limits.loss_tokens) if of_loss else limits.tokens
                    while left:
                        size = min(left, most)
                        if n and (n + size > limits.tokens or bears + size * of_loss > limits.loss_tokens):
                            owner.append(i)
                            lengths.append(n)
                            loss.append(bears)
                            n = bears = 0
                        n, bears, left = n + size, bears + size * of_loss, left - size
                owner.append(i)
                lengths.append(n)
                loss.append(bears)
            pieces = np.array(pack(np.array(lengths, np.int64), np.array(loss, np.int64), limits, cut=False), np.int64).reshape(-1, 5)
            at = pieces[:, 0]
            columns = [batch.column(0).take(pa.array(np.array(owner, np.int64)[at])), pa.array(pieces[:, 2]), pa.array(np.array(loss, np.int64)[at]), pa.array(first + pieces[:, 3]), pa.array(pieces[:, 4])]
            first += int(pieces[:, 3].max(initial=-1)) + 1
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "length", "loss_tokens", "sequence_id", "offset"])

    return whole.mapInArrow(each, f"conv_id {kind}, length long, loss_tokens long, sequence_id long, `offset` long")
