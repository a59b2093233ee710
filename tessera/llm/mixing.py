"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash of its id and text; a source's share is the documents
whose hash lies at or below the source's threshold, so shares of different budgets
are nested and nothing is sorted. The threshold comes from histograms of token
mass by (source, hash bucket): the first level finds the bucket in which the
budget ends, each further level splits only that bucket, and the last looks at
the few documents left in it. Each histogram is a partial aggregation with at
most 2**bits groups a source, so a source that holds a third of all rows costs
no more than another.

A source whose target is above its size is repeated whole as often as it fits,
and the threshold picks what is repeated once more.

Equal rows (one doc_id, one text) share a hash; where the budget ends among
them, as many as fit are taken, by their rank within the partitions they were
read in, so that no task has all of them.

Nulls: a null text has size 0; a null source is a source of its own, last in
order; a null doc_id hashes as the empty string, with its text. Very long texts
are counted where they lie. An empty table gives an empty result. Other columns
are ignored. The plan is found by jobs that run while mix() is called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cluster import fresh, stored

WEIGHTS = (5, 2, 1)
CAP = 3
HASH_BITS = 60
LEVEL_BITS = 12
LEVELS = 3
WORD = r"[^\x20\x09-\x0D]+"


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text, as any SQL engine can compute them."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h, part): one pass over the texts; part is the partition that a row was read in."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("h"), F.spark_partition_id().alias("part"))


def targets(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares of the total by weight, none above cap times its source.

    Filling by weight until none is above its cap is a water level: with sources
    in the order of cap over weight, the level is what the uncapped share once
    those before are full.
    """
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double"))
    per = per.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("fill", F.col("most") / F.col("w"))
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.coalesce(F.least("most", F.col("w") * F.col("level")), F.col("most")).alias("target"))


def thresholds(base: DataFrame, budgets: DataFrame, levels: int = LEVELS, bits: int = LEVEL_BITS) -> DataFrame:
    """(source, threshold, edge, fit) for (source, budget): documents with h <= threshold, and `fit` of the equal ones with h = edge, weigh about the budget.

    The document in which the budget ends is taken if that comes nearer to it.
    """
    left = base.select("source", "size", "h")
    # prefix: the high bits of the boundary bucket so far; done: the mass below it
    edge = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    for level in range(1, levels + 1):
        shift = HASH_BITS - bits * level
        inside = left.join(edge.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + bits) == F.col("prefix")), "left_semi") if level > 1 else left
        bars = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        e = edge.select(F.col("source").alias("s"), "budget", "done")
        upto = F.col("done") + F.sum("mass").over(Window.partitionBy("source").orderBy("bucket"))
        bars = bars.join(e, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", upto)
        edge = bars.where(F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("mass")).alias("done"), "budget")).alias("x")).select("source", "x.budget", F.col("x.bucket").alias("prefix"), "x.done")
    shift = HASH_BITS - bits * levels
    e = edge.select(F.col("source").alias("s"), "budget", "prefix", "done")
    units = left.join(e, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix"))).groupBy("source", "h").agg(F.sum("size").alias("mass"), F.count("*").alias("n"), F.first("budget").alias("budget"), F.first("prefix").alias("prefix"), F.first("done").alias("done"))
    before = F.col("done") + F.coalesce(F.sum("mass").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col("budget") - before
    # of n equal rows, the i-th is taken if the budget is nearer to its end than to its start
    fits = F.when(F.col("mass") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor(room * F.col("n") / F.nullif("mass", F.lit(0)) + 0.5)))).otherwise(F.when(room >= 0, F.col("n")).otherwise(0))
    units = units.withColumn("fit", fits.cast("long"))
    low = F.shiftleft(F.first("prefix"), shift) - 1
    part = F.min(F.when((F.col("fit") > 0) & (F.col("fit") < F.col("n")), F.struct("h", "fit")))
    return units.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("fit") == F.col("n"), F.col("h"))), low).alias("threshold"), part["h"].alias("edge"), part["fit"].alias("fit"))


def plan(base: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, source_size, target, whole, threshold, edge, fit): a row for each source s."""
    goal = targets(base, weights, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = stored(goal.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    cut = thresholds(base, goal.select("source", "budget")).withColumnRenamed("source", "s")
    goal = goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return stored(goal.select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1)).alias("threshold"), "edge", "fit"))


def among_equals(rows: DataFrame, source: str, part: str, name: str) -> DataFrame:
    """rows with their rank from 1 within the source, in column `name`: counts by part, then ranks within each part."""
    many = rows.groupBy(F.col(source).alias("_s"), F.col(part).alias("_p")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    many = many.withColumn("_n", F.coalesce(upto, F.lit(0)))
    rank = F.col("_n") + F.row_number().over(Window.partitionBy(source, part).orderBy(F.lit(0)))
    return rows.join(many, F.col(source).eqNullSafe(F.col("_s")) & (F.col(part) == F.col("_p"))).withColumn(name, rank).drop("_s", "_p", "_n")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats): how often the mix takes each document."""
    base = stored(sized(docs))
    goal = plan(base, weights, cap)
    rows = base.join(goal, F.col("source").eqNullSafe(F.col("s")))
    columns = lambda more: ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + more.cast("long")).alias("repeats")]
    if not goal.where("fit > 0").limit(1).count():
        return rows.select(*columns(F.col("h") <= F.col("threshold")))
    edge = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    some = among_equals(rows.where(edge), "source", "part", "_rank")
    return rows.where(~edge).select(*columns(F.col("h") <= F.col("threshold"))).unionAll(some.select(*columns(F.col("_rank") <= F.col("fit"))))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; the texts are filtered where they lie."""
    goal = plan(stored(sized(docs)), weights, cap)
    s, whole, threshold, edge, fit, n, h, part, rank = (fresh(docs, f"_{c}") for c in ("source", "whole", "threshold", "edge", "fit", "times", "hash", "part", "rank"))
    goal = goal.select(F.col("s").alias(s), F.col("whole").alias(whole), F.col("threshold").alias(threshold), F.col("edge").alias(edge), F.col("fit").alias(fit))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn(h, row_hash(F.col("doc_id"), F.col("text"))).join(goal, F.col("source").eqNullSafe(F.col(s)))
    ends = F.coalesce(F.col(h) == F.col(edge), F.lit(False))
    rows = hashed.withColumn(n, F.col(whole) + (F.col(h) <= F.col(threshold)).cast("long"))
    if goal.where(F.col(fit) > 0).limit(1).count():
        some = among_equals(stored(hashed.where(ends).withColumn(part, F.spark_partition_id())), "source", part, rank).drop(part)
        rows = rows.where(~ends).unionAll(some.withColumn(n, F.col(whole) + (F.col(rank) <= F.col(fit)).cast("long")).drop(rank))
    return rows.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*columns)
