"""Seeded one-to-one mappings of positions, computed by arithmetic alone.

A Feistel network permutes a grid of a x b places, the largest with a = floor(sqrt(n)) that n places hold. The fewer than
a + 1 places left over stay where they are, so the network runs twice, each time after a rotation by another amount: every
step is one-to-one on 0..n-1, and no place has to be tried again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modulus of the round functions, and their factors: two rotations, then four rounds of each pass.
PRIME = (1 << 31) - 1
TURNS = (16807, 48271)
ROUNDS = ((69621, 39373, 62089, 50873), (40014, 40692, 45991, 49297))


def seed_number(seed: object) -> int:
    """A number below `PRIME` for any seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16) % PRIME


def repeat_key(seed: object, repeat: Column) -> Column:
    """Key of the mapping of one repeat."""
    return (F.lit(seed_number(seed)) + repeat.cast("long") * F.lit(1000003)) % F.lit(PRIME)


def _mixed(x: Column, factor: int, key: Column) -> Column:
    y = (x * F.lit(factor) + key) % F.lit(PRIME)
    return (y * y) % F.lit(PRIME)


def permuted(df: DataFrame, place: str, n: str, key: Column, name: str) -> DataFrame:
    """`df` with `name`: where the mapping `key` sends `place`, one of 0..n-1 (`n` is a column too, up to 2**62)."""
    kept = [c for c in df.columns if c != name]
    a = F.floor(F.sqrt(F.col(n).cast("double")))
    df = df.select(*kept, F.col(place).cast("long").alias("_x"), key.cast("long").alias("_key"), a.alias("_a"))
    df = df.withColumn("_b", F.expr(f"cast({n} as bigint) div _a"))
    for turn, rounds in zip(TURNS, ROUNDS):
        df = df.withColumn("_x", (F.col("_x") + _mixed(F.col("_key"), turn, F.lit(turn))) % F.col(n))
        df = df.withColumns({"_l": F.expr("_x div _b"), "_r": F.col("_x") % F.col("_b")})
        for k, factor in enumerate(rounds):
            moved, other, size = ("_r", "_l", "_b") if k % 2 == 0 else ("_l", "_r", "_a")
            df = df.withColumn(moved, (F.col(moved) + _mixed(F.col(other), factor, F.col("_key"))) % F.col(size))
        inside = F.col("_x") < F.col("_a") * F.col("_b")
        df = df.withColumn("_x", F.when(inside, F.col("_l") * F.col("_b") + F.col("_r")).otherwise(F.col("_x")))
    # Never null, so that a join on it pushes no null check, with all rounds written out, below the steps.
    return df.select(*kept, F.coalesce("_x", F.lit(-1)).alias(name))
