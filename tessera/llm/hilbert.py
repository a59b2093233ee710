"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to `bits` bits; the curve index of the cell orders
the rows, and runs of that order become shards, so that a shard's minima and
maxima are narrow in every dimension at once and file pruning works on each.
The rank of a row is found without a global sort: counts by cell, then by cell
and a salt of the key, give where each (cell, salt) starts, and only rows of
one (cell, salt) are numbered together. A cell with a third of all rows is thus
dealt over `SALTS` tasks. The counts by cell are at most 2**(bits * dimensions).

The texts are read once: what is ranked is a narrow table in the shared folder,
written by a job of its own.

Only DataFrame functions run here. Nulls: a null text has 0 bytes, a null
dimension is a value of its own, rows of one key or of none are dealt out by the
CRC of their texts too. Equal rows are interchangeable. A long text is measured
where it lies. An empty table gives an empty result. Other columns are ignored,
but `write_shards` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cluster import fresh, stored

BITS = 5
SALTS = 4096
SHARDS = 40


def category(value: Column, bits: int = BITS) -> Column:
    """A cell coordinate for a category: its CRC, cut to the bits; null is 0."""
    return F.when(value.isNull(), 0).otherwise(F.crc32(value.cast("string")) % (1 << bits)).cast("long")


def magnitude(value: Column, bits: int = BITS) -> Column:
    """A cell coordinate for a size of 16 or more: two steps for each doubling."""
    step = F.floor(F.log2(F.greatest(value, F.lit(16)).cast("double")) * 2) - 8
    return F.least(step, F.lit((1 << bits) - 1)).cast("long")


def curve_index(dims: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve, after Skilling's transform (AIP Conf. Proc. 707, 2004)."""
    n = len(dims)
    xor, fields = (lambda a, b: a.bitwiseXOR(b)), [f"x{i}" for i in range(n)]
    pack = lambda xs: F.struct(*(x.cast("long").alias(f) for x, f in zip(xs, fields, strict=True)))
    state = pack(dims)
    turns = [(q, i) for q in (1 << b for b in range(bits - 1, 0, -1)) for i in range(n)]
    steps = F.array(*(F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in turns))

    def turn(s: Column, step: Column) -> Column:
        q, x0 = step["q"], s["x0"]
        xi = F.coalesce(*(F.when(step["i"] == i, s[f]) for i, f in enumerate(fields)))
        hit = xi.bitwiseAND(q) != 0
        swap = xor(x0, xi).bitwiseAND(q - 1)
        first = F.when(hit, xor(x0, q - 1)).otherwise(xor(x0, swap))
        rest = [F.when((step["i"] == i) & ~hit, xor(s[f], swap)).otherwise(s[f]) for i, f in enumerate(fields) if i]
        return pack([first, *rest])

    def finish(s: Column) -> Column:
        gray = [s["x0"]]
        for f in fields[1:]:
            gray.append(xor(gray[-1], s[f]))
        flip = F.lit(0).cast("long")
        for q in (1 << b for b in range(bits - 1, 0, -1)):
            flip = xor(flip, F.when(gray[-1].bitwiseAND(F.lit(q).cast("long")) != 0, q - 1).otherwise(0).cast("long"))
        index = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(xor(gray[i], flip), b).bitwiseAND(F.lit(1).cast("long"))
                index = index + F.shiftleft(bit, b * n + n - 1 - i)
        return index

    return F.aggregate(steps, state, turn, finish)


def ranked(rows: DataFrame, cell: str, key: str, ties: list[str]) -> DataFrame:
    """rows with `rank`, gapless from 0 in the order of cell, salt, key and ties, and `total`."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(key, *ties), F.lit(SALTS)))
    counts = rows.groupBy(F.col(cell).alias("_c"), F.col("_salt").alias("_s")).agg(F.count("*").alias("_n"))
    cells = counts.groupBy("_c").agg(F.sum("_n").alias("_n"))
    along = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # over the cells: a bounded number
    cells = cells.select(F.col("_c").alias("_cc"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_from"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("_c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(cells, F.col("_c") == F.col("_cc")).select("_c", "_s", (F.col("_from") + F.col("_in")).alias("_start"), "total")
    number = F.row_number().over(Window.partitionBy(cell, "_salt").orderBy(key, *ties)) - 1
    return rows.join(starts, (F.col(cell) == F.col("_c")) & (F.col("_salt") == F.col("_s"))).withColumn("rank", F.col("_start") + number).drop("_salt", "_c", "_s", "_start")


def placed(rows: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot) for (doc_id, size, text_crc32, cell)."""
    out = ranked(rows, "cell", "doc_id", ["text_crc32", "size"])
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(rank * {shards} div total * total + {shards - 1}) div {shards}")
    return out.select(*rows.columns, shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))


def measured(docs: DataFrame, bits: int = BITS) -> list[Column]:
    """Columns size, text_crc32 and cell of documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 16).cast("long")
    return [size.alias("size"), F.crc32(text).alias("text_crc32"), curve_index([category(F.col("source"), bits), category(F.col("lang"), bits), magnitude(size, bits)], bits).alias("cell")]


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """(doc_id, size, text_crc32, cell, shard, slot): counts of the shards differ by one at most."""
    return placed(stored(docs.select("doc_id", *measured(docs, bits))), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> None:
    """Whole documents as Parquet, one folder shard=i each; a reader's filters on source, lang or size skip most of them.

    The documents are shuffled once to be ranked and once to their shards.
    """
    row = fresh(docs, "_row")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("doc_id", *measured(docs, bits), F.struct(*columns).alias(row))
    out = placed(rows, shards).select(F.col("shard").alias("shard"), "slot", row)
    out = out.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    out.select("shard", f"{row}.*").write.partitionBy("shard").parquet(path)
