"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned to Python objects at a time, and bytes of Arrow data above which fewer are (one at least).
SLICE, SLICE_BYTES = 256, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets one; a cluster raises,
    as its executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        checkpoint = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = checkpoint.get() if checkpoint.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives the planner the true size, so that a join
    with the result is broadcast only if it is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearfield/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def _slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def map_slices(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow over slices of so many rows, or fewer where they are large: make() is called once a task and returns a
    function from columns (lists of Python values) to columns of the schema."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in _slices(batch, rows):
                made = each({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_hash(*columns, seed: str = "") -> F.Column:
    """A double in [0, 1) from a hash of the columns, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) * F.lit(2.0**-53)
