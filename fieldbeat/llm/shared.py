"""Small helpers of the operators: the shared folder, staged tables, Arrow columns."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Text bytes that a Python task handles at once; one longer text is still one piece.
BATCH_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see. Set here only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="fieldbeat-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Writes an intermediate table to the shared folder and reads it back.

    Cuts the lineage: what follows depends on files that outlive any executor, so the shuffles
    that led there are freed at once. The files stay until ``discard``, or as long as the folder
    does where a result still reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def discard(*staged: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in staged:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def in_batches(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``mapInArrow``, with this package sent along for executors that do not have it."""
    _send_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def _send_package(spark: SparkSession) -> None:
    context = spark.sparkContext
    if getattr(context, "_fieldbeat_sent", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.TemporaryDirectory()  # the driver's own, which Spark sends on; kept to its end
    archive = shutil.make_archive(
        f"{folder.name}/fieldbeat", "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    context._fieldbeat_sent = folder


def with_fields(schema: StructType, *fields: StructField) -> StructType:
    """The schema with these fields at its end; fields of the same name are replaced."""
    names = {f.name for f in fields}
    return StructType([f for f in schema if f.name not in names] + list(fields))


def replaced(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with these columns at its end; columns of the same name are replaced."""
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays(
        [batch.column(n) for n in kept] + list(columns.values()), [*kept, *columns])


def slices(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each, at least one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    cuts = np.unique(starts[:-1] // limit, return_index=True)[1]
    for start, end in zip(cuts, [*cuts[1:], n], strict=True):
        yield batch.slice(start, end - start)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    return [v or b"" for v in batch.column(column).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A text column as strings; null is empty."""
    return [v or "" for v in batch.column(column).to_pylist()]


def lists(values: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """A list column from all lists' values in a row and the size of each list."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def pack(df: DataFrame, *apart: str) -> DataFrame:
    """The columns ``apart``, and all others in one column ``rest``: no name can clash with
    what an operator adds."""
    others = [c for c in df.columns if c not in apart]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    return df.select(*apart, rest.alias("rest"))


def unpack(df: DataFrame, columns: list[str], *more: Column, **changed: Column) -> DataFrame:
    """Undoes ``pack``: these columns in this order, some of them changed, and more."""
    inside = set(df.schema["rest"].dataType.names)

    def column(name: str) -> Column:
        if name in changed:
            return changed[name]
        return F.col("rest").getField(name) if name in inside else F.col(name)

    return df.select(*[column(c).alias(c) for c in columns], *more)
