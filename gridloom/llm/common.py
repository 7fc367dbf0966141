"""Helpers that the operators of this subpackage share.

Every operator takes DataFrames with a 64-bit integer ``doc_id`` and a string ``text``; other columns are ignored, so
extra columns and clashing names do no harm. A null text counts as empty. Rows whose ``doc_id`` is null are kept and
treated like any other id where the operator's contract allows it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step handles at once.
SLICE_BYTES = 2 << 20
#: Rows and bytes that cross from the JVM to Python at once; whole texts can be long.
ARROW_ROWS, ARROW_BYTES = 4000, 4 << 20


def prepare(spark: SparkSession) -> None:
    """Sets what the Python steps rely on: small Arrow batches, so that whole long texts cross in bounded memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it. Where none is named, a folder of this machine if
    it is the whole cluster, as in tests; else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{tempfile.gettempdir()}/gridloom-checkpoints"


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables written to the shared folder: they cut lineage, so that a lost executor costs a reread and not a rerun.

    ``keep`` writes and rereads; ``drop`` deletes a table that no later step needs. What is left goes when the driver's
    Python ends, since a returned DataFrame still reads it.
    """

    left: ClassVar[list[tuple[SparkSession, str]]] = []
    tables: ClassVar[list[tuple[SparkSession, str]]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.names = spark, f"{shared_folder(spark)}/gridloom-{uuid.uuid4().hex}", 0
        Scratch.left.append((spark, self.root))

    def keep(self, df: DataFrame) -> DataFrame:
        self.names += 1
        path = f"{self.root}/{self.names}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_at = path
        return out

    def keep_bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """Kept in buckets by a column: later joins on it don't move these rows."""
        self.names += 1
        path, name = f"{self.root}/{self.names}", f"gridloom_{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
        Scratch.tables.append((self.spark, name))
        out = self.spark.table(name)
        out._kept_at = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._kept_at)


def _remove_left() -> None:
    for spark, name in Scratch.tables:
        with contextlib.suppress(Exception):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    for spark, path in Scratch.left:
        with contextlib.suppress(Exception):
            remove(spark, path)


atexit.register(_remove_left)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with null texts empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def fold_of(doc_id: str, n: int):
    """crc32 of the id as text, modulo ``n``: the split into training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def give_back() -> None:
    """Memory that earlier tasks of this Python worker have freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def lean(step: Callable) -> Callable:
    """A step that begins and ends with as little memory held as can be: workers are reused."""

    def run(batches):
        give_back()
        yield from step(batches)
        give_back()

    return run


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(lean(step), schema)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``most`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = np.cumsum(size) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's texts as one byte array and the offsets of its rows in it (a null is empty)."""
    column = pa.compute.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = pa.large_binary()
    column = column.cast(kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def labelled(docs: DataFrame, labels: DataFrame, label: str, train, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled training rows, those with the lowest hash of their id. The chosen ids
    are bounded, so they are broadcast and the texts stay where they are."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & train)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    )
    return docs.join(F.broadcast(chosen), "doc_id")


def filtered(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text ``keep`` accepts, with all their columns."""

    def step(batches):
        for batch in batches:
            for part in slices(batch):
                text = pa.compute.fill_null(part.column("text"), "")
                yield part.filter(pa.array(keep(text), pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(lean(step), docs.schema)


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` within each pair of neighbouring offsets; empty segments give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
