"""Tables that are kept up to date: upserts, synchronisation, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, incoming: DataFrame, key: Sequence[str], fill: Sequence[str] = (), last: Sequence[str] = (), first: Sequence[str] = (), add: Sequence[str] = ()) -> DataFrame:
    """Both tables as one row for each key. fill: the existing value unless it is null; last, first: the greater or lesser value; add: the sum.

    incoming must have each key once (see first_of). Columns named nowhere take the incoming value where there is a row.
    """
    rest = [c for c in existing.columns if c not in {*key, *fill, *last, *first, *add}]
    a, b = existing.alias("a"), incoming.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    both = a.withColumn("_a", F.lit(True)).alias("a").join(b.withColumn("_b", F.lit(True)).alias("b"), on, "full_outer")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    made = {k: F.coalesce(x(k), y(k)) for k in [*key, *fill]} | {c: F.greatest(x(c), y(c)) for c in last} | {c: F.least(x(c), y(c)) for c in first}
    made |= {c: F.coalesce(x(c), F.lit(0)) + F.coalesce(y(c), F.lit(0)) for c in add} | {c: F.when(F.col("_b"), y(c)).otherwise(x(c)) for c in rest}
    return both.select(*[made[c].alias(c) for c in existing.columns])


def first_of(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def synchronised(known: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """known with `active`: whether each is still listed. An empty list deactivates nothing, as it tells of a failed fetch."""
    some = listed.limit(1).select(F.lit(True)).scalar()  # null if nothing is listed
    k = known.join(listed.select(key).distinct().withColumn("_listed", F.lit(True)), key, "left")
    return k.withColumn("active", F.coalesce(F.col("_listed"), some.isNull())).drop("_listed")


def retained(df: DataFrame, key: Sequence[str], order: Sequence, most: int = 20) -> DataFrame:
    """The latest rows of each key, `most` of them; the limit applies before the shuffle, too."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes df over those partitions of a table at path that it has rows for; others stay. A retry leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
