"""Keyed permutations of ranges as columns: Feistel networks on two coordinates, so any size works."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
#: Steps of cycle walking. A range of n has less than sqrt(n) + 1 points too many, which a walk of that many steps must
#: leave; for larger n a walk so long has a chance of less than n ** -(WALK / 2).
WALK = 48


def _next(x: Column, a: Column, b: Column, key: Sequence[Column]) -> Column:
    """One pass through the network on [0, a) x [0, b), as one expression."""
    state = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, (s["l"] + F.pmod(F.xxhash64(*key, i, s["r"]), a)) % a).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, (s["r"] + F.pmod(F.xxhash64(*key, i, s["l"]), b)) % b).otherwise(s["r"]).alias("r"),
        )

    out = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), state, turn)
    return out["l"] * b + out["r"]


def permuted(df: DataFrame, out: str, x: Column, n: Column, key: Sequence[Column]) -> DataFrame:
    """Adds out: x in [0, n) carried to another number of [0, n), one to one for equal n and key.

    The first pass is generated code, one projection a round; the few numbers that leave the range walk on.
    """
    df = df.withColumns({"_x": x.cast("long"), "_n": n.cast("long")})
    df = df.withColumn("_a", F.greatest(F.lit(1), F.ceil(F.sqrt("_n"))).cast("long")).withColumn("_b", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.col("_a"))).cast("long"))
    df = df.withColumns({"_l": F.floor(F.col("_x") / F.col("_b")).cast("long"), "_r": F.col("_x") % F.col("_b")})
    for i in range(ROUNDS):
        half, other, side = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_b")
        df = df.withColumn(half, (F.col(half) + F.pmod(F.xxhash64(*key, F.lit(i), F.col(other)), F.col(side))) % F.col(side))
    first = F.col("_l") * F.col("_b") + F.col("_r")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda y, i: F.when(y < F.col("_n"), y).otherwise(_next(y, F.col("_a"), F.col("_b"), key)))
    df = df.withColumn(out, F.when(first < F.col("_n"), first).otherwise(walk))
    df = df.withColumn(out, F.when(F.col(out) < F.col("_n"), F.col(out)).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long")))
    return df.drop("_x", "_n", "_a", "_b", "_l", "_r")
