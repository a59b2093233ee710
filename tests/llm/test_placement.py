"""Shards and mixes."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert, mixing

from llm_samples import WORD


def curve_cells(bits, dims):
    """Cells along the curve by brute force: inverse of the transform, after the same paper."""
    cells = []
    for index in range(1 << bits * dims):
        x = [0] * dims
        for b in range(bits):
            for i in range(dims):
                x[i] |= (index >> (b * dims + dims - 1 - i) & 1) << b
        t = x[-1] >> 1
        for i in range(dims - 1, 0, -1):
            x[i] ^= x[i - 1]
        x[0] ^= t
        q = 2
        while q != 1 << bits:
            for i in range(dims - 1, -1, -1):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q <<= 1
        cells.append(tuple(x))
    return cells


@pytest.mark.parametrize(("bits", "dims"), [(3, 2), (2, 3)])
def test_curve(spark, bits, dims):
    cells = curve_cells(bits, dims)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(cells, cells[1:], strict=False))
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], ["i", *(f"d{k}" for k in range(dims))])
    got = df.select("i", hilbert.curve_index([F.col(f"d{k}") for k in range(dims)], bits).alias("x"))
    assert all(r.i == r.x for r in got.collect())


def test_shards(edge, empty):
    rows = hilbert.shard_documents(edge, 7).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in edge.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(7)) and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    cells = [r.cell for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert cells == sorted(cells)
    assert hilbert.shard_documents(empty).count() == 0
    repeated = edge.unionAll(edge).withColumn("doc_id", F.lit(None).cast("long"))
    count = Counter(r.shard for r in hilbert.shard_documents(repeated, 4).collect()).values()
    assert sum(count) == 2 * len(rows) and max(count) - min(count) <= 1
    assert "Python" not in hilbert.shard_documents(edge)._jdf.queryExecution().executedPlan().toString()


def test_written_shards_can_be_skipped(spark, tmp_path):
    n = 4000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(9)) * F.pmod(F.xxhash64("id"), F.lit(9)) * 30).cast("int")).alias("text"), F.concat(F.lit("l"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("string")).alias("lang"), F.concat(F.lit("s"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(6)).cast("string")).alias("source"))
    hilbert.write_shards(docs, str(tmp_path / "out"), 40)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, out.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    for condition in ("source = 's3'", "lang = 'l1'", "length(text) > 3000", "source = 's3' and lang = 'l1'"):
        # shards that hold such a row: a file's minima and maxima leave few more to be read
        assert out.where(condition).select("shard").distinct().count() <= 24, condition
    assert out.where("source = 's3' and lang = 'l1'").select("shard").distinct().count() <= 6


def fill(sizes, weights, cap=3):
    """Targets by filling again and again."""
    total, full, target = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        w = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [float(cap * sizes[i]) if i in full else rest * weights[i] / w for i in range(len(sizes))]
        above = {i for i in range(len(sizes)) if i not in full and target[i] > cap * sizes[i]}
        if not above:
            return target
        full |= above


def test_targets(spark):
    for sizes in ([1000, 10, 10, 500], [5, 5, 5], [0, 0, 7], [100], [1, 2000, 3, 4000, 1]):
        base = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
        got = {r.source: r.target for r in mixing.targets(base).collect()}
        want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_mix(spark, edge, empty):
    rows = mixing.mix(edge).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in edge.select("doc_id", "text").collect())
    assert all(0 <= r.repeats <= 3 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns
    taken = Counter(r.doc_id for r in mixing.mixed_documents(edge).collect())
    want = Counter()
    for r in rows:
        want[r.doc_id] += r.repeats
    assert taken == +want


def test_mix_of_equal_rows(spark):
    """Rows without ids, equal rows: each source's words come within one document of its target all the same."""
    rows = [(None, " ".join(["w"] * 10) + (f" x{i}" if i % 2 else " y"), "a") for i in range(1000)] + [(7, "b " * 20, "b")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r["size"] * r.repeats
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10.5 for s in target)
    assert Counter(r.text for r in mixing.mixed_documents(docs).collect()).total() == sum(r.repeats for r in got)


def test_mix_comes_near(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).otherwise("hot").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    for levels, bits in ((3, 12), (1, 2), (2, 20)):
        base = mixing.sized(df).cache()
        plan = mixing.targets(base).withColumn("budget", F.least(F.col("target"), F.col("source_size") * 0.9))
        cut = {r.source: r.threshold for r in mixing.thresholds(base, plan.select("source", "budget"), levels, bits).collect()}
        budget = {r.source: r.budget for r in plan.collect()}
        got = Counter()
        for r in base.collect():
            got[r.source] += r["size"] * (r.h <= cut.get(r.source, -1))
        assert all(abs(got[s] - budget[s]) <= 20 for s in budget)
