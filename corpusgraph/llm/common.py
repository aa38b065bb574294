"""What the operators of this subpackage share: the shared folder, durable steps, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows that a Python worker is handed at once: texts can be long, and a batch is held whole.
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed (on a cluster: --py-files), and bound their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local (tests) a temporary folder is taken.
    """
    prepare(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = base.get() if base.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/corpusgraph-{uuid.uuid4().hex}/{name}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and text columns, under these two fixed names; a null text counts as empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def arrow_rows(batches: Iterator, *columns: str) -> Iterator[list[list]]:
    """The columns of each Arrow batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]


#: MB of its own beyond which a worker gives up what it remembers between tasks and collects garbage, which takes some
#: 50 ms, and beyond which it returns free memory; a worker that has just begun holds about 55.
WORKER_MB, TRIM_MB = 230, 80
#: Functions that drop what a module remembers.
FORGET: list[Callable[[], None]] = []


def bounded(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function after which its worker, which Spark keeps for later tasks, returns free memory to the system."""

    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def give_back() -> None:
    import pyarrow as pa

    try:
        with open("/proc/self/statm") as f:
            pages = f.read().split()
        own = (int(pages[1]) - int(pages[2])) * os.sysconf("SC_PAGE_SIZE") / 1e6
    except OSError:
        own = float("inf")
    if own < TRIM_MB:
        return
    if own > WORKER_MB:
        for forget in FORGET:
            forget()
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
