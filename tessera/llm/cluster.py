"""What the operators need from the session: partition counts and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The tables that stored() has written within the scratch() that is open here.
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


#: Bytes of a batch that goes to a Python worker: a few thousand texts, or one longer one.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what the JVM and each Python worker hold of a partition at once, whatever the length of its texts.

    Spark has this setting for whole sessions only, so it stays set; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, None) or 1 << 40) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs on this machine, and an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(found)
    return found


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Collects the tables that stored() writes within, in this thread and what it calls, so that they can be released."""
    tables: list[str] = []
    before = _tables.set(tables)
    try:
        yield tables
    finally:
        _tables.reset(before)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: its lineage ends there.

    The table is deleted by release(), or when the driver's JVM ends in good order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    tables = _tables.get()
    if tables is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def release(spark: SparkSession, tables: list[str], keep: int = 0) -> None:
    """Deletes these tables but for the last `keep`; what reads them must be done."""
    end = len(tables) - keep
    for path in tables[:end]:
        system, place = _file_system(spark, path)
        system.delete(place, True)
    del tables[:end]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df doesn't have yet; case doesn't count."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
