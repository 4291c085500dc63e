"""Saved indexes: one Parquet folder a component and a manifest; and tables that cut a lineage."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import InvalidArgument, NotEmpty, NotFound


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which the whole cluster shares. Where it is unset, a local master gets one; a cluster raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = tempfile.mkdtemp(prefix="nearfield-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/index/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, only: set[str] | None = None) -> None:
    """only: the components to write, such as the trained model without data."""
    names = sorted(n for n in tables if only is None or n in only)
    for n in names:
        tables[n].write.mode("overwrite").parquet(f"{path}/{n}")
    fs, p = _fs(spark, f"{path}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest | {"components": names}, sort_keys=True).encode()))
    out.close()


def load(spark: SparkSession, path: str, persist: dict[str, StorageLevel] | None = None) -> tuple[dict[str, DataFrame], dict]:
    """persist: storage levels of components that are to be held."""
    fs, p = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        raise NotFound(f"no index at {path}")
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in manifest["components"]}
    return {n: t.persist(persist[n]) if persist and n in persist else t for n, t in tables.items()}, manifest


def must_be_empty(tables: dict) -> None:
    if tables:
        raise NotEmpty("an index is loaded into an empty one")
