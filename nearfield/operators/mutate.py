"""Adding, removing, updating and merging rows of an index; every change gives a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.errors import InvalidArgument


def add(base: DataFrame, new: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(base with new rows, failed ids). Ids that exist, and repeated ids in the batch but the first, fail."""
    first = Window.partitionBy("id").orderBy(F.col(order) if order else F.xxhash64(*[F.col(c) for c in new.columns]))
    numbered = new.withColumn("_n", F.row_number().over(first))
    known = base.select("id")
    fresh = numbered.filter("_n = 1").drop("_n").join(known, "id", "left_anti")
    failed = numbered.filter("_n > 1").select("id").union(numbered.filter("_n = 1").join(known, "id", "left_semi").select("id")).distinct()
    return base.unionByName(fresh, allowMissingColumns=True), failed


def mark_removed(tombstones: DataFrame, ids: DataFrame) -> DataFrame:
    return tombstones.select("id").union(ids.select("id")).distinct()


def alive(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Also force-remove: what is left without the removed rows."""
    return base.join(tombstones.select("id"), "id", "left_anti")


def update_id(base: DataFrame, old: int, new: int) -> DataFrame:
    return base.withColumn("id", F.when(F.col("id") == old, F.lit(new)).otherwise(F.col("id")))


def update(base: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Replaces the columns of rows that changes (id, columns) has; other ids of it are ignored."""
    if not columns:
        raise InvalidArgument("no columns to update")
    new = changes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    rows = base.join(new, base.id == new["_id"], "left")
    return rows.select(*[F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def merge(base: DataFrame, other: DataFrame, id_map: Column | None = None) -> DataFrame:
    """Both indexes' rows; id_map gives the other's ids (a column of id)."""
    rows = other if id_map is None else other.withColumn("id", id_map)
    return base.unionByName(rows, allowMissingColumns=True)


def apply_log(base: DataFrame, log: DataFrame) -> DataFrame:
    """log: (id, at, action add or remove, and the columns of base but id). The last action of an id decides, of several
    at one time the one whose columns have the largest hash."""
    last = Window.partitionBy("id").orderBy(F.desc("at"), F.desc(F.xxhash64(*[F.col(c) for c in sorted(log.columns)])))
    final = log.withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    kept = base.join(final.select("id"), "id", "left_anti")
    return kept.unionByName(final.filter("action = 'add'").select(*base.columns))
