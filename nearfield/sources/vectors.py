"""Vectors from numpy arrays, sparse arrays and byte streams."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import DimensionMismatch, InvalidArgument


def dense(spark: SparkSession, vectors: np.ndarray, ids: np.ndarray | None = None, dtype: str | None = None) -> DataFrame:
    """(id, vector) of a 2-D array; dtype bfloat16 takes uint16 payloads."""
    x = np.asarray(vectors)
    if x.ndim != 2:
        raise DimensionMismatch("vectors must be two-dimensional")
    ids = np.arange(len(x)) if ids is None else np.asarray(ids)
    if len(ids) != len(x):
        raise InvalidArgument("one id a vector")
    if dtype == "bfloat16":
        x = (x.astype(np.uint32) << 16).view(np.float32)
    elif dtype == "float16" and x.dtype == np.uint16:
        x = x.view(np.float16)
    kind = pa.list_(pa.int8()) if x.dtype == np.int8 else pa.list_(pa.float32())
    values = x if x.dtype == np.int8 else x.astype(np.float32)
    return spark.createDataFrame(pa.table({"id": pa.array(ids.astype(np.int64)), "vector": pa.array(list(values), kind)}))


def sparse(spark: SparkSession, offsets: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray | None = None) -> DataFrame:
    """(id, ids, vals) of row offsets, term ids and values."""
    n = len(offsets) - 1
    ids = np.arange(n) if ids is None else np.asarray(ids)
    rows = [(int(ids[i]), [int(t) for t in terms[offsets[i] : offsets[i + 1]]], [float(v) for v in values[offsets[i] : offsets[i + 1]]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, ids array<long>, vals array<float>")


def decode_sparse(data: bytes) -> list[tuple[list[int], list[float]]]:
    """Records of a little-endian count, that many uint32 terms and that many float32 values."""
    out, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            raise InvalidArgument("the stream ends within a count")
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + 8 * n > len(data):
            raise InvalidArgument("the stream ends within a record")
        out.append((list(struct.unpack_from(f"<{n}I", data, at)), list(struct.unpack_from(f"<{n}f", data, at + 4 * n))))
        at += 8 * n
    return out


def sparse_stream(rows: DataFrame, column: str = "data") -> DataFrame:
    """(id, ids, vals) of one encoded record in each row of (id, data)."""

    def run(batches):
        for b in batches:
            got = [decode_sparse(x.as_py())[0] for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], names=["id", "ids", "vals"])

    return rows.select("id", column).mapInArrow(run, "id long, ids array<long>, vals array<float>")
