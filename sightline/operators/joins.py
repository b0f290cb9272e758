"""Joins that the engine lacks, as compositions of what it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], left_time: str, right_time: str, take: Sequence[str], tie: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """left with `take` of the latest row of right with an equal key and a time up to left's (before it, if strict); null if there is none.

    Both are put in one sequence and the last row of right is carried along it, so no rows are paired, however many right has. Of right rows of
    one time the last by `tie` counts. Null keys and times find nothing.
    """
    value = F.struct(*[F.col(c).alias(c) for c in take])
    r = right.where(" and ".join(f"{k} is not null" for k in [*key, right_time])).select(*key, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*(tie or [F.lit(0).alias("none")])).alias("_tie"), value.alias("_value"))
    whole = F.struct(*[F.col(c).alias(c) for c in left.columns]).alias("_left")
    a = left.select(*key, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), whole)
    both = r.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_left is not null")
    known = F.lit(True)
    for k in [*key, "_t"]:
        known = known & F.col(k).isNotNull()
    return found.select("_left.*", *[F.when(known, F.col(f"_found.{c}")).alias(c) for c in take])


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """key and a boolean for each named set: which of them has the key. One aggregate over all sets instead of a chain of full outer joins; null keys are left out."""
    names = list(sets)
    every = None
    for name, df in sets.items():
        part = df.select(F.col(key).alias(key), F.lit(name).alias("_set")).where(F.col(key).isNotNull())
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(*[F.max(F.col("_set") == n).alias(n) for n in names])


def first_answer(asked: DataFrame, answers: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """key, value, how: the answer of the first of several tables that has the key, and which one it was (from 0); of several values the least. Keys without an answer are left out."""
    every = None
    for i, df in enumerate(answers):
        part = df.select(F.col(key), F.col(value), F.lit(i).alias("how"))
        every = part if every is None else every.unionByName(part)
    best = every.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct("how", value)).alias("_b"))
    return asked.select(key).distinct().join(best, key).select(key, F.col(f"_b.{value}").alias(value), F.col("_b.how").alias("how"))
