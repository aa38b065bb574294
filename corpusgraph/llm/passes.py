"""Several passes over one table without shuffling its texts.

Rows are numbered by scan partition and place in it. What a later pass must know of a row is written to the shared folder
by that partition, and the pass reads only its own partition's part. The table must read alike each time, as files do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder
from .token_store import open_store


def numbered(docs: DataFrame, *more: Column | str) -> DataFrame:
    """__row (scan partition in the bits from 33 on, place in it below) and the columns asked for.

    How files are split depends on the number of cores, which a lost executor changes; so that all passes split alike,
    that number is held from the first pass on, unless the session sets it.
    """
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        spark.conf.set("spark.sql.files.minPartitionNum", spark.sparkContext.defaultParallelism)
    return docs.select(F.monotonically_increasing_id().alias("__row"), *more)


def by_partition(wanted: DataFrame, row: str, name: str) -> str:
    """Write rows into the shared folder by the scan partition that their row number tells; returns the folder."""
    folder = shared_folder(wanted.sparkSession, name)
    part = F.shiftright(F.col(row), 33)
    wanted.withColumn("part", part).repartition(F.col("part"), F.pmod(F.col(row), F.lit(4))).write.partitionBy("part").parquet(folder)
    return folder


def of_partition(folder: str, row: int, columns: list[str]) -> list[np.ndarray | list]:
    """What by_partition() wrote for the partition of this row; Spark committed the folder before."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = open_store(f"{folder}/part={row >> 33}")
    if store.get_file_info(base.rsplit("/", 1)[0]).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} isn't a folder that the driver wrote and this executor sees")
    if store.get_file_info(base).type == fs.FileType.NotFound:
        return [[] for _ in columns]
    table = pq.ParquetDataset(base, filesystem=store, partitioning=None).read(columns=columns)
    return [table.column(c).to_pylist() for c in columns]
