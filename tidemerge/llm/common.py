"""What the operators share: reading a table, cutting lineage in the shared folder, and bounded Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, read by Spark so that any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns renamed by place (c0, c1, ...), so that names of the caller's can't clash with an operator's own."""
    return df.select(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). A temporary one only where none is set and all of Spark is one
    process; elsewhere other machines could not read it, so that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemerge-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, and where: computed once, read by all that follow, and still there when an executor is
    lost. It goes when the application ends, or by discard()."""
    spark = df.sparkSession
    where = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where), where


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def discard(spark: SparkSession, where: str | None) -> None:
    """Remove a table of written_at() that nothing will read any more."""
    if where:
        path, fs = _path(spark, where)
        fs.delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts hold about most_bytes together; a longer text stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
