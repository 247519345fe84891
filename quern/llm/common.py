"""What the operators of this subpackage share: tables, lineage cuts, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = 8 << 20
#: Bytes of a table that goes to every executor.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="quern-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.
    Only a local session may do without; a cluster without one is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = _local_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    Unions of such tables must not be zipped by partition: that fails where
    adaptive execution has given them other numbers of partitions."""
    shared_dir(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, which takes less room for narrow rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session was started with a size of its own:
    tables of texts with some very long ones make the default's batches large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def map_rows(df: DataFrame, schema: T.StructType | str, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a function of one batch; ``f`` may yield several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)

    tune(df.sparkSession)
    return df.mapInArrow(run, schema)


def hinted(df: DataFrame, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a check of the bytes of a written table; beyond
    ``size`` Spark joins by shuffle."""
    wide = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(wide.cast("long")), F.lit(0))).first()[0] <= size else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids``, an id column named anything; rows
    with a null doc_id stay."""
    name = fresh(docs, "__bad_id")
    bad = cut(ids.select(F.col(ids.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct())
    return docs.join(hinted(bad), docs["doc_id"] == F.col(name), "left_anti")


def id_type(docs: DataFrame) -> T.DataType:
    return docs.schema["doc_id"].dataType


def ragged_sum(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[i]:firsts[i+1]]; empty runs sum to 0."""
    cum = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return cum[firsts[1:]] - cum[firsts[:-1]]
