"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower case. Features are the presence of
word n-grams (one to three words) and skip-grams (pairs over one or two words),
hashed into 2**BITS coordinates. FTRL-proximal (McMahan et al., 2013) has a
learning rate for each coordinate and L1 that leaves most weights exactly zero,
so the model that goes to the executors is a few coordinates, whatever the size
of the corpus. It is fitted in one task on at most SAMPLE labelled rows of each
class, those with the smallest hash of doc_id (of the rows of one doc_id, the
least text), and of these on the first SAMPLE_BYTES of text, whole texts only.
Where SAMPLE leaves out more of one class than of the other, the bias is set
right by the logarithm of that ratio, so that scores are those of the corpus's
shares at every size. Scoring reads whole texts.

Only the text is an input of the score. Nulls: a null or empty text has the
score of no features; a row without a label isn't trained on. Where no label
may be learnt from, every score is 0. Extra columns are ignored. The weights are
fitted by jobs that run while scored() is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cluster import bounded_batches, fresh

BITS = 20
#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 3000
#: Bytes of text that the model is fitted on, at most.
SAMPLE_BYTES = 128 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.01, 5
THRESHOLD = 0.3
GRAMS, SKIPS = 3, (1, 2)
#: Anything that is no ASCII letter, digit or part of a longer UTF-8 sequence separates words.
OUTSIDE = np.ones(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    OUTSIDE[_a:_b] = False


def grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, coordinate) arrays for each kind of feature, repeats included."""
    lower = C.LOWER[data]
    starts, ends, woff = C.words(lower, off, OUTSIDE)
    if not len(starts):
        return
    h, doc = C.span_hashes(lower, starts, ends), C.owners(woff)
    fold = lambda x: (C.mix(x) >> C.U(64 - BITS)).astype(np.int64)
    yield doc, fold(h)
    chain = h
    for k in range(2, GRAMS + 1):
        if len(h) < k:
            return
        chain = C.mix(chain[:-1]) + h[k - 1 :]
        same = doc[: len(chain)] == doc[k - 1 :]
        yield doc[: len(chain)][same], fold(chain[same] + C.U(k))
    for gap in SKIPS:
        if len(h) < gap + 2:
            return
        pair = C.mix(h[: -gap - 1]) + h[gap + 1 :]
        same = doc[: len(pair)] == doc[gap + 1 :]
        yield doc[: len(pair)][same], fold(pair[same] + C.U(100 + gap))


class FTRL:
    def __init__(self, size: int = 1 << BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, at: np.ndarray, y: int) -> None:
        """One step on the example that has the coordinates `at`."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that aren't zero; the last coordinate 1 << BITS is the bias."""
    data, off = C.strings(texts)
    rows: list[np.ndarray] = []
    for i, j in C.blocks(off):
        keys = [d << (BITS + 1) | f for d, f in grams(data[off[i] : off[j]], off[i : j + 1] - off[i])]
        keys = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.int64)
        rows += np.split((keys & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(keys >> (BITS + 1), np.arange(1, j - i)))
    model = FTRL()
    rng = np.random.Generator(np.random.PCG64(1))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            model.learn(rows[i], int(labels[i]))
    w = model.weights(slice(None))
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Sparse weights from docs (doc_id, text) and labels (doc_id, toxic): at most `sample` rows of each class.

    The rows are chosen among the labels, so that no other text is moved. One
    doc_id with several labels has the greatest.
    """
    h = F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(1 << 40))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("_id is not null and toxic in (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("h", h)
    some, ratio = None, {0: 1.0, 1: 1.0}
    for row in known.groupBy("toxic").count().collect():
        ratio[row["toxic"]] = min(1.0, sample / row["count"])
        low_enough = F.col("h") < int(min(1.0, (1.5 * sample + 100) / row["count"]) * (1 << 40))
        part = known.where((F.col("toxic") == row["toxic"]) & low_enough).orderBy("h", "_id").limit(sample)
        some = part if some is None else some.unionAll(part)
    if some is None:
        return {}
    # 2 * sample ids at most; of the rows of one, however many, the least text
    some = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], SAMPLE_BYTES
        for batch in batches:  # in the order of h
            size = np.cumsum(np.diff(C.strings(batch.column(3))[1]))
            first = int(np.searchsorted(size, room, "right"))
            if first:
                parts.append(batch.slice(0, first))
            room = room - int(size[-1]) if first == len(size) and first else -1 if len(size) else room
        table = pa.Table.from_batches(parts) if parts else None
        if table is None or not table.num_rows:
            return
        at, w = fit(table["text"], table["toxic"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    weights = {r["at"]: r["w"] for r in some.repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(each, "at long, w double").collect()}
    if weights:
        weights[1 << BITS] = weights.get(1 << BITS, 0.0) + float(np.log(ratio[0] / ratio[1]))
    return weights


def score(docs: DataFrame, weights: dict[int, float], text: str = "text", name: str = "score") -> DataFrame:
    """docs with the probability of being toxic in column `name`, which replaces one of that name."""
    bounded_batches(docs.sparkSession)
    bias = weights.get(1 << BITS, 0.0)
    at = np.array([k for k in weights if k < 1 << BITS], np.int64)
    values = np.array([weights[k] for k in at.tolist()])
    known = bool(weights)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        w = np.zeros(1 << BITS)
        w[at] = values
        data, off = C.strings(texts)
        logit = np.full(len(texts), bias)
        for i, j in C.blocks(off):
            hits = [np.unique(d[w[f] != 0] << (BITS + 1) | f[w[f] != 0]) for d, f in grams(data[off[i] : off[j]], off[i : j + 1] - off[i])]
            hits = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
            logit[i:j] += np.bincount(hits >> (BITS + 1), w[hits & ((1 << BITS) - 1)], j - i)
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -35, 35))) if known else np.zeros(len(texts)))

    return docs.withColumn(name, probability(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted; labels of held-out rows are not learnt from."""
    weights = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), weights).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below THRESHOLD, whole rows."""
    name = fresh(docs, "_score")
    weights = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, weights, name=name).where(F.col(name) < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
