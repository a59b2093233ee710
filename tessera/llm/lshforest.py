"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document is its set of distinct SHINGLE-word shingles. Documents with the
same words in the same order (the first 128 bits of their SHA-256) are one from
the start. Each of the others has TREES * DEPTH minima; tree t sorts the
documents by its DEPTH of them, and documents next to each other in that order,
which have the longest common prefixes, are candidates: a region that shares a
prefix is taken whole where it is small, and where it is large only at the depth
at which it becomes small, besides its first document. Candidates whose
signatures agree too seldom for the similarity asked for are dropped (4.5
standard deviations below it).

Components of candidates are then confirmed on the full sets, which are
compared by their words' bytes. A component of up to BLOCK documents is
confirmed in one task, exactly, whatever pairs proposed it. A larger one is
dealt into blocks of BLOCK with LEADERS common documents, each confirmed
exactly. What is then still in several parts goes through the trees again, each
tree's order now going on through RUN_DEPTH minima, so that a region becomes
deeper the more documents it has; runs of BLOCK documents of each order are
confirmed exactly, and the parts that a confirmed link joins are one. A document
takes part in TREES runs at most, so the work grows with the documents, not with
their pairs.

Links join documents with 100 * intersection >= PERCENT * union. A pair with a
similarity of 0.85 shares a prefix of four minima in some tree with a
probability of 0.99999, and of one minimum of each with more; in a component of
n documents (over BLOCK) whose others resemble each other by s, the pair stands
in one run if it agrees on log(n / BLOCK) / log(1 / s) minima of some tree.

Nulls: a null text is empty; a document without words has no shingles and no
links; one with fewer than SHINGLE words has its whole sequence as its only
shingle. A null doc_id is linked with nothing. Rows of one doc_id are one
document of all their links. A long text is one set, built in one task. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cluster import bounded_batches, fresh, partitions, stored
from tessera.llm.graph import components, local_components

SHINGLE, PERCENT = 5, 85
TREES, DEPTH = 16, 4
HASHES = TREES * DEPTH
#: Neighbours on a side that are compared; a region of one more is small.
NEAR = 12
LEAST_AGREEMENT = 0.65
BLOCK, LEADERS = 1024, 16
#: Minima by which a run's order goes.
RUN_DEPTH = 32
#: A word sequence held by more than one in HOT documents is joined by broadcast: there are fewer than HOT of those.
HOT = 2048
CHUNK = 1 << 17
WORDS = r"[^\x20\x09-\x0D]"
#: Rows of a region that a batch sends at least.
KEEP = 64
U = C.U
_rng = np.random.Generator(np.random.PCG64(8))
FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, ...]:
    """(hashes, soff, words, starts, ends, whole): the distinct shingles of each text, ascending by hash, as spans of
    `words`; whole has the span of each text's words."""
    d, starts, ends, woff = C.tidy(C.LOWER[data], off)
    n, size = len(off) - 1, np.diff(woff)
    count = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    at = C.ragged(woff[:-1], count)
    doc = np.repeat(np.arange(n), count)
    wide = np.minimum(size[doc], k)
    first, last = starts[at], ends[at + wide - 1] if len(at) else at
    h, short = np.empty(len(at), np.uint64), wide < k
    h[short] = C.span_hashes(d, first[short], last[short])
    h[~short] = C.rolling(C.span_hashes(d, starts, ends), k)[at[~short]]

    def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        return order, new

    order, new = ordered(h)
    again = np.flatnonzero(~new)
    one, other = order[again], order[again - 1]
    odd = ~C.equal_spans(d, first[one], last[one], first[other], last[other])
    if odd.any():  # a collision: these shingles by another hash
        some = np.unique(np.concatenate((one[odd], other[odd])))
        h[some] = C.digests(d, first[some], last[some])[:, 0]
        order, new = ordered(h)
    keep = order[new]
    whole = np.zeros((n, 2), np.int64)
    full = size > 0
    whole[full] = np.stack((starts[woff[:-1][full]], ends[woff[1:][full] - 1]), 1)
    return h[keep], np.searchsorted(doc[keep], np.arange(n + 1)), d, first[keep], last[keep], whole


def signatures(h: np.ndarray, soff: np.ndarray) -> np.ndarray:
    """Minima (n, HASHES) of 32 bits of the sets that aren't empty."""
    full = soff[:-1][np.diff(soff) > 0]
    out = np.empty((len(full), HASHES), np.uint32)
    for i in range(HASHES if len(full) else 0):
        out[:, i] = np.minimum.reduceat(h * FACTORS[i] + SHIFTS[i], full) >> U(32)
    return out


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) if len(x) else pa.array([], pa.binary())


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, minima, brief): minima big-endian, so that binary order is theirs; brief has a byte of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "k1", "k2", "minima", "brief"]
        for batch in batches:
            data, off = C.strings(batch.column(1))
            for i, j in C.blocks(off):
                h, soff, words, _, _, whole = shingles(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(soff)
                full = np.flatnonzero(n > 0)
                minima = signatures(h, soff)
                k1, k2 = C.digests(words, *whole[full].T).T
                place = pa.array(np.where(n > 0, np.cumsum(n > 0) - 1, 0), mask=n == 0)
                brief = np.ascontiguousarray((minima & 0xFF).astype(np.uint8))
                keyed = [pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), _fixed(np.ascontiguousarray(minima.astype(">u4")).view(np.uint8).reshape(len(full), -1)), _fixed(brief)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), *(x.take(place) for x in keyed)], names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, n_shingles long, k1 long, k2 long, minima binary, brief binary")


def neighbours(tree: np.ndarray, prefix: np.ndarray, brief: np.ndarray, ids: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of rows that are sorted by tree and prefix (n, DEPTH)."""
    n = len(ids)
    common = np.zeros(n, np.int64)  # with the row before
    if n > 1:
        same = (prefix[1:] == prefix[:-1]) & (tree[1:] == tree[:-1])[:, None]
        common[1:] = np.cumprod(same, 1).sum(1)
    a, b = [], []
    depth = np.full(n, DEPTH)
    first = np.empty((DEPTH, n), np.int64)
    for d in range(DEPTH, 0, -1):
        start = np.flatnonzero(common < d)
        size = np.diff(np.append(start, n))
        first[d - 1] = np.repeat(start, size)
        depth[np.repeat(size, size) <= near + 1] = d
    for s in range(1, min(near, n - 1) + 1):
        shared = common[s:].copy()
        for t in range(1, s):
            np.minimum(shared, common[s - t : n - t], out=shared)
        i = np.flatnonzero(shared >= np.minimum(depth[s:], depth[:-s]))
        a.append(i)
        b.append(i + s)
    for d in range(DEPTH):
        i = np.flatnonzero(first[d] != np.arange(n))
        a.append(first[d][i])
        b.append(i)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
    keep = ids[a] != ids[b]
    a, b = a[keep], b[keep]
    agree = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        agree[i : i + (1 << 16)] = (brief[a[i : i + (1 << 16)]] == brief[b[i : i + (1 << 16)]]).sum(1)
    keep = agree >= LEAST_AGREEMENT * HASHES
    return a[keep], b[keep]


ROW = "tree int, prefix binary, brief binary, doc_id long, root long"


def condensed(prefix: np.ndarray, brief: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sent, joined, root): of rows in the tree's order, which go on, and which are joined here with the first of their region.

    Only where more than KEEP rows of one batch share the first minimum, and
    only rows whose signatures agree with the first one's as those of linked
    documents do: what is joined here needs no neighbour elsewhere.
    """
    n = len(ids)
    start = np.flatnonzero(np.append(True, prefix[1:, 0] != prefix[:-1, 0]))
    size = np.diff(np.append(start, n))
    first, place = np.repeat(start, size), np.arange(n) - np.repeat(start, size)
    far = np.flatnonzero((np.repeat(size, size) > KEEP) & (place >= KEEP))
    alike = far[(brief[far] == brief[first[far]]).sum(1) * 100 >= PERCENT * HASHES]
    sent = np.ones(n, bool)
    sent[alike] = False
    return np.flatnonzero(sent), alike, first[alike]


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b) edges that join all candidates of the forest, from (doc_id, minima, brief).

    A region that very many documents share is condensed batch by batch before
    it is shuffled, as a partial aggregation would be.
    """
    wide = 4 * DEPTH

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy()
            minima = C.strings(batch.column(1))[0].reshape(n, 4 * HASHES)
            brief = C.strings(batch.column(2))[0].reshape(n, HASHES)
            for t in range(TREES):
                raw = np.ascontiguousarray(minima[:, t * wide : (t + 1) * wide])
                prefix = raw.view(">u4")
                order = np.lexsort((ids, *prefix.T[::-1]))
                sent, joined, root = condensed(prefix[order], brief[order], ids[order])
                rows = order[sent]
                empty = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), _fixed(raw[rows]), batch.column(2).take(pa.array(rows)), pa.array(ids[rows]), empty], ["tree", "prefix", "brief", "doc_id", "root"])
                if len(joined):
                    m = len(joined)
                    key = _fixed(np.ascontiguousarray(ids[order[joined]].astype(">i8")).view(np.uint8).reshape(m, 8))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1, np.int32)), key, pa.nulls(m, pa.binary()), pa.array(ids[order[joined]]), pa.array(ids[order[root]])], ["tree", "prefix", "brief", "doc_id", "root"])

    rows = sets.select("doc_id", "minima", "brief").mapInArrow(spread, ROW)
    # joined rows have tree -1 and are dealt by their ids, the others by tree and first minimum
    rows = rows.repartition(partitions(sets.sparkSession), "tree", F.when(F.col("tree") < 0, F.col("prefix")).otherwise(F.expr("substring(prefix, 1, 4)"))).sortWithinPartitions("tree", "prefix", "brief", "doc_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> pa.RecordBatch:
            n = table.num_rows
            raw = lambda c: C.strings(table[c])[0]
            prefix = raw("prefix").reshape(n, wide).copy().view(">u4")
            ids = table["doc_id"].to_numpy()
            a, b = neighbours(table["tree"].to_numpy(), prefix, raw("brief").reshape(n, HASHES), ids)
            distinct, own = np.unique(ids, return_inverse=True)
            root = local_components(len(distinct), own[a], own[b])
            some = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(distinct[some]), pa.array(distinct[root[some]])], ["a", "b"])

        for batch in batches:
            done = int(np.searchsorted(batch.column(0).to_numpy(), 0))
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(3).slice(0, done), batch.column(4).slice(0, done)], ["a", "b"])
            if done < batch.num_rows:
                held.append(batch.slice(done))
            if sum(x.num_rows for x in held) >= CHUNK:
                table = pa.Table.from_batches(held)
                yield edges(table)
                held = table.slice(max(0, table.num_rows - NEAR)).to_batches()  # what follows is next to these
        if held:
            yield edges(pa.Table.from_batches(held))

    return rows.mapInArrow(each, "a long, b long")


class Sets:
    """Shingle sets of some texts, for intersections of one with many.

    Sets that are linked have a shingle in common among their first, rarest
    ones: of n, those beyond PERCENT of them and one more.
    """

    def __init__(self, texts: pa.ChunkedArray):
        data, off = C.strings(texts)
        made = [shingles(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in C.blocks(off)]
        self.size = np.concatenate([np.diff(m[1]) for m in made]) if made else np.empty(0, np.int64)
        self.off = np.concatenate(([0], np.cumsum(self.size)))
        shift = np.cumsum([0, *(len(m[2]) for m in made)])
        join = lambda k, by: np.concatenate([m[k] + x * by for m, x in zip(made, shift.tolist(), strict=False)]) if made else np.empty(0, np.int64)
        words = np.concatenate([m[2] for m in made]) if made else np.empty(0, np.uint8)
        ids, first = C.numbered(words, join(3, 1), join(4, 1), np.concatenate([m[0] for m in made]) if made else np.empty(0, np.uint64))
        owner = C.owners(self.off)
        self.ids = ids[np.lexsort((ids, np.bincount(ids, minlength=1)[ids], owner))]  # the rarest of each set first
        self.mark, self.seen = np.zeros(len(first), bool), np.zeros(len(self.size), bool)
        self.ahead = np.where(self.size > 0, self.size - (PERCENT * self.size + 99) // 100 + 1, 0)
        rare = C.ragged(self.off[:-1], self.ahead)
        by = np.argsort(self.ids[rare], kind="stable")
        self.holders = owner[rare[by]]
        self.at = np.searchsorted(self.ids[rare[by]], np.arange(len(first) + 1))

    def near(self, one: int, many: np.ndarray) -> np.ndarray:
        """Those of `many` that have one of their rarest shingles in common with `one`."""
        rare = self.ids[self.off[one] : self.off[one] + self.ahead[one]]
        found = self.holders[C.ragged(self.at[rare], self.at[rare + 1] - self.at[rare])]
        self.seen[found] = True
        many = many[self.seen[many]]
        self.seen[found] = False
        return many

    def linked(self, one: int, many: np.ndarray) -> np.ndarray:
        """Those of `many` that are linked with `one`."""
        n = self.size[one]
        many = self.near(one, many)
        many = many[100 * np.minimum(self.size[many], n) >= PERCENT * np.maximum(self.size[many], n)]
        if not len(many):
            return many
        own = self.ids[self.off[one] : self.off[one + 1]]
        self.mark[own] = True
        hits = self.mark[self.ids[C.ragged(self.off[many], self.size[many])]]
        self.mark[own] = False
        common = C.sums(hits, np.concatenate(([0], np.cumsum(self.size[many]))))
        return many[100 * common >= PERCENT * (n + self.size[many] - common)]

    def components(self) -> np.ndarray:
        """Each set's component, as the number of its first set; exact."""
        root = np.full(len(self.size), -1)
        rest = np.arange(len(self.size))
        while len(rest):
            seed, rest = rest[0], rest[1:]
            root[seed] = seed
            queue = [seed]
            while queue and len(rest):
                found = self.linked(queue.pop(), rest)
                root[found] = seed
                queue += found.tolist()
                rest = rest[root[rest] < 0]
        return root


PAIR = "a long, b long, large boolean"


def _pairs(a: np.ndarray, b: np.ndarray, large: bool) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([large] * len(a), pa.bool_())], ["a", "b", "large"])


def _within(table: pa.Table) -> pa.Table:
    """Each document of a block with the first of its component there."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table["doc_id"].to_numpy()
    root = Sets(table["text"]).components()
    return _pairs(ids, ids[root], table["blocks"][0].as_py() > 1)


def _between(table: pa.Table) -> pa.Table:
    """The labels of a run's documents with those of the documents of other labels that they are linked with."""
    label = table["label"].to_numpy().copy()
    sets = Sets(table["text"])
    a, b = [], []
    for i in range(len(label)):
        later = np.arange(i + 1, len(label))
        for other in np.unique(label[sets.linked(i, later[label[later] != label[i]])]).tolist():
            a.append(label[i])
            b.append(other)
            label[label == other] = label[i]
    return _pairs(np.array(a, np.int64), np.array(b, np.int64), True)


def runs(rows: DataFrame) -> DataFrame:
    """(doc_id, label, run) for (cand, doc_id, label, minima): runs of BLOCK documents of each tree's order within each cand."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            minima = C.strings(batch.column(3))[0].reshape(n, 4 * HASHES)
            round_ = np.concatenate((minima, minima), 1)
            for t in range(TREES):
                key = np.ascontiguousarray(round_[:, 4 * DEPTH * t : 4 * (DEPTH * t + RUN_DEPTH)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, t, np.int32)), _fixed(key), batch.column(1), batch.column(2)], ["cand", "tree", "key", "doc_id", "label"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            out = []
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (c, t) != last or held == BLOCK:
                    run, held, last = run + 1, 0, (c, t)
                held += 1
                out.append(run)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(out, pa.int64())], ["doc_id", "label", "run"])

    spreads = rows.select("cand", "doc_id", "label", "minima").mapInArrow(spread, "cand long, tree int, key binary, doc_id long, label long")
    ordered = spreads.repartitionByRange(partitions(rows.sparkSession), "cand", "tree", "key").sortWithinPartitions("cand", "tree", "key", "doc_id")
    return ordered.mapInArrow(cut, "doc_id long, label long, run long")


def confirmed(docs: DataFrame, proposed: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, root) of the components by links on full sets, for the documents in proposed (node, root); sets: (doc_id, minima)."""
    count = proposed.groupBy(F.col("root").alias("_r")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    part = proposed.join(count, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), F.col("root").alias("cand"), "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(part.hint("merge"), F.col("doc_id") == F.col("_n")).drop("_n")  # what is joined grows with the documents
    members = stored(texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    large = members.where("blocks > 1")
    order = Window.partitionBy("cand").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    leaders = large.select("cand", "doc_id", "block", "blocks", F.row_number().over(order).alias("k")).where(F.col("k") <= LEADERS)
    lent = leaders.select(F.col("cand").alias("_c"), F.col("doc_id").alias("_d"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"))
    lent = large.join(lent, (F.col("cand") == F.col("_c")) & (F.col("doc_id") == F.col("_d")) & (F.col("block") != F.col("_b"))).select("cand", F.col("_b").alias("block"), "doc_id", "text", "blocks")
    first = stored(members.select("cand", "block", "doc_id", "text", "blocks").unionAll(lent).groupBy("cand", "block").applyInArrow(lambda t: _within(t), PAIR))
    small = first.where("not large").groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    if not large.limit(1).count():
        return small
    of = components(first.where("large").select("a", "b"))
    label = stored(large.select("doc_id", "cand").join(of, F.col("doc_id") == F.col("node"), "left").select("doc_id", "cand", F.coalesce("root", "doc_id").alias("label")))
    roots = label.select(F.col("doc_id").alias("node"), F.col("label").alias("root"))
    # components of candidates in several parts so far
    open_ = label.groupBy(F.col("cand").alias("_c")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("_c")
    rest = label.join(open_, F.col("cand") == F.col("_c"), "left_semi").dropDuplicates(["doc_id"])
    rest = stored(rest.join(sets.select(F.col("doc_id").alias("_d"), "minima").dropDuplicates(["_d"]), F.col("doc_id") == F.col("_d")).select("cand", "doc_id", "label", "minima"))
    if not rest.limit(1).count():
        return small.unionAll(roots)
    dealt = runs(rest).select(F.col("doc_id").alias("_d"), "label", "run")
    together = large.join(dealt, F.col("doc_id") == F.col("_d")).select("run", "label", "text")
    met = components(together.groupBy("run").applyInArrow(lambda t: _between(t), PAIR).select("a", "b"))
    joined = roots.join(met.select(F.col("node").alias("_l"), F.col("root").alias("_m")), F.col("root") == F.col("_l"), "left")
    return small.unionAll(joined.select("node", F.coalesce("_m", "root").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable by links, itself included.

    Several jobs run while this is called: their tables are in the shared folder.
    """
    base = stored(signed(docs))
    full = base.where("n_shingles > 0 and doc_id is not null")
    same = stored(full.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # a document of its own for each distinct sequence; rows of one doc_id with different ones meet under it
    sets = full.join(same.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "rep"), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    proposed = components(candidates(sets.select("doc_id", "minima", "brief")))
    joined = confirmed(docs, proposed, sets)
    top = same.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), F.coalesce("root", "rep").alias("component_id"), "copies")
    top, total = stored(top), same.agg(F.sum("copies")).first()[0] or 0
    common = F.col("copies") * HOT > total
    keys = (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2"))
    full = full.select("doc_id", "n_shingles", "k1", "k2")
    hot = F.broadcast(top.where(common))  # fewer than HOT rows
    out = full.join(hot, keys).unionAll(full.join(hot, keys, "left_anti").join(top.where(~common), keys))
    rest = base.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "n_shingles", "component_id").unionAll(rest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component, whole rows: that of the smallest doc_id.

    Of rows with one doc_id and one text with words, whichever one stays; rows
    of one doc_id with different texts all do, as do rows without words.
    """
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone, "doc_id", "left_anti").select(*columns)
    name = fresh(docs, "_repeated")
    many = stored(docs.groupBy(F.col("doc_id").alias(name)).count().where(F.col("count") > 1).select(name))
    if not many.limit(1).count():
        return kept
    repeated = F.col("doc_id") == F.col(name)
    again = kept.join(many.hint("merge"), repeated, "left_semi").select(*columns)
    words = F.coalesce(F.col("text").rlike(WORDS), F.lit(False))
    single = again.where(words).dropDuplicates(["doc_id", "text"]).unionAll(again.where(~words))
    return kept.join(many.hint("merge"), repeated, "left_anti").select(*columns).unionAll(single)
