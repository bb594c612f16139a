"""What the operators of this subpackage share: reading, batching and intermediate tables."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reefline.session import checkpoint_root

SLICE_BYTES = 16 * 1024 * 1024


def ship(name: str) -> None:
    """Send the code of a module with its functions, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder for intermediate tables."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: lineage ends at a table that outlives executors."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder of intermediate tables through Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as a long and ``text`` with null as empty, without any other column but ``more``."""
    return docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *[docs[c] for c in more],
    )


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a part hold about ``size`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast("int64"))
    ends = ends.to_numpy(zero_copy_only=False)
    start = base = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(ends.searchsorted(base + size, side="right")))
        yield batch.slice(start, stop - start)
        base = int(ends[stop - 1])
        start = stop
