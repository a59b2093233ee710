"""Two rounds in which hashes of all documents meet, without a row for each hash.

Documents are dealt into groups of about GROUP_BYTES by a hash of doc_id and
text. A group sends one packed blob to each bucket of the hash space; a bucket
sees every group's blob and answers each with a blob of its own. A second round
does the same with what the first left over, and the last step ends with the
group's documents again. A group sends each distinct hash once, so a hash that
a third of all documents hold reaches its bucket once for each group, not once
for each document.

Groups and buckets grow with the bytes, so blobs between all pairs of them would
grow with the square. Beyond ONE_HOP pairs they go by way of relays, as in a
radix exchange: a group sends one blob to each stretch of `fan` buckets, a relay
for each stretch and each `fan`-th part of the groups deals them out, and the
number of messages is that of the groups times twice the root of the buckets.

The texts are shuffled once: all three steps read the same exchange. Their
total size is found beforehand by a job of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cluster import partitions

#: Bytes of text of a group, about; a partition has two of them.
GROUP_BYTES = 16 << 20
#: Pairs of a group and a bucket that exchange messages without relays.
ONE_HOP = 1 << 22

MESSAGE = "`to` int, via int, blob binary"
MESSAGE_TYPE = pa.schema([("to", pa.int32()), ("via", pa.int32()), ("blob", pa.binary())])


class Group:
    """A group's documents, by doc_id (null first) and a hash of the text: bytes, offsets and ids."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("tie", "ascending"), ("text", "ascending")]) if table.num_rows else table
        nulls = table["doc_id"].is_null()
        table = pa.concat_tables([table.filter(nulls), table.filter(pa.compute.invert(nulls))]) if table["doc_id"].null_count else table
        self.doc_id = table["doc_id"].combine_chunks()
        self.ids = self.doc_id.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        self.ties = table["tie"].combine_chunks().to_numpy().astype(np.uint32)
        self.data, self.off = C.strings(table["text"])


def packed(parts: Iterable[tuple[int, int, bytes]], fan: int) -> pa.Table:
    """Messages for parts (destination, sender, payload): one for each stretch of `fan` destinations and sender modulo fan."""
    rows: dict[tuple[int, int], list[tuple[int, int, bytes]]] = {}
    for part in parts:
        rows.setdefault((part[0] // fan, part[1] % fan), []).append(part)
    blobs = [b"".join((np.array([len(x), *(v for p in x for v in (p[0], p[1], len(p[2])))], np.int64).tobytes(), *(p[2] for p in x))) for x in rows.values()]
    return pa.table([pa.array([k[0] for k in rows], pa.int32()), pa.array([k[1] for k in rows], pa.int32()), pa.array(blobs, pa.binary())], schema=MESSAGE_TYPE)


def parts(table: pa.Table) -> Iterator[tuple[int, int, bytes]]:
    """The parts that a table of messages holds."""
    for blob in table["blob"].to_pylist():
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        head = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(n, 3).tolist()
        at = 8 + 24 * n
        for to, sender, size in head:
            yield to, sender, blob[at : at + size]
            at += size


def read(table: pa.Table) -> dict[int, bytes]:
    """Payloads by sender, in its order."""
    return dict(sorted((sender, payload) for _, sender, payload in parts(table)))


def two_rounds(
    docs: DataFrame,
    send: Callable[[Group, int], dict[int, bytes]],
    answer: Callable[[dict[int, bytes]], dict[int, bytes]],
    send_again: Callable[[Group, int, dict[int, bytes]], dict[int, bytes]],
    answer_again: Callable[[dict[int, bytes]], dict[int, bytes]],
    finish: Callable[[Group, int, dict[int, bytes]], pa.Table],
    schema: str,
) -> DataFrame:
    """send and send_again give blobs by bucket, answer and answer_again blobs by group.

    What send_again gives for bucket -1 goes to its own group's finish, as bucket -1.
    """
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    groups = max(n + n // 3 + 1, -(-total // GROUP_BYTES))
    buckets = max(n, groups // 2)
    fan = 1 if groups * buckets <= ONE_HOP else int(np.ceil(np.sqrt(groups)))
    text = F.col("text").cast("string")
    dealt = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), text), F.lit(groups)).cast("int").alias("to"), F.col("doc_id").cast("long").alias("doc_id"), F.pmod(F.xxhash64(text), F.lit(1 << 32)).alias("tie"), text.alias("text")).repartition(buckets, "to")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        return packed(((b, g, blob) for b, blob in send(Group(table), buckets).items()), fan)

    def second(key: tuple, replies: pa.Table, table: pa.Table) -> pa.Table:
        g = key[0].as_py()
        if not table.num_rows:
            return MESSAGE_TYPE.empty_table()
        sent = send_again(Group(table), buckets, read(replies))
        own = sent.pop(-1, b"")
        # the group's own state rides along with a bucket, marked by -1 - g
        return packed([*((b, g, blob) for b, blob in sent.items()), (g % buckets, -1 - g, own)], fan)

    def meet(f: Callable[[dict[int, bytes]], dict[int, bytes]]) -> Callable[[tuple, pa.Table], pa.Table]:
        def each(key: tuple, table: pa.Table) -> pa.Table:
            b, got = key[0].as_py(), read(table)
            own = [(-1 - g, -1, got.pop(g)) for g in [g for g in got if g < 0]]
            return packed([*((g, b, blob) for g, blob in (f(got) if got else {}).items()), *own], fan)

        return each

    def third(key: tuple, replies: pa.Table, table: pa.Table) -> pa.Table:
        return finish(Group(table), buckets, read(replies))

    def exchanged(messages: DataFrame) -> DataFrame:
        """The messages, by their destinations."""
        if fan > 1:
            messages = messages.groupBy("to", "via").applyInArrow(lambda _, table: packed(parts(table), 1), MESSAGE)
        return messages.repartition(buckets, "to")

    back = exchanged(dealt.groupBy("to").applyInArrow(first, MESSAGE)).groupBy("to").applyInArrow(meet(answer), MESSAGE)
    back = exchanged(exchanged(back).groupBy("to").cogroup(dealt.groupBy("to")).applyInArrow(second, MESSAGE)).groupBy("to").applyInArrow(meet(answer_again), MESSAGE)
    return exchanged(back).groupBy("to").cogroup(dealt.groupBy("to")).applyInArrow(third, schema)


def bucket_slices(b: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) runs of a sorted array of buckets."""
    if not len(b):
        return []
    cut = np.flatnonzero(np.diff(b)) + 1
    return list(zip(b[np.concatenate(([0], cut))].tolist(), [0, *cut.tolist()], [*cut.tolist(), len(b)], strict=True))
