"""Weights, age decay and the append-only confidence ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The share of a weight that is left from an age in days on, and the weight of each kind of source.
SCHEDULE = ((30, 0.90), (90, 0.75), (180, 0.50), (365, 0.30))
NEVER_DECAYS = ("official",)
SOURCE_WEIGHTS = {"support_page": 10, "certification": 20, "firmware": 25, "ota": 20, "retail": 35, "official": 100, "other": 20}
UNKNOWN_WEIGHT = 10


def source_weight(source_type: Column, override: Column | None = None) -> Column:
    """The weight of a kind of source; a positive override counts instead; an unknown or null kind weighs UNKNOWN_WEIGHT."""
    known = F.create_map(*[x for k, v in SOURCE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    base = F.coalesce(known[source_type], F.lit(UNKNOWN_WEIGHT))
    return base if override is None else F.when(override > 0, override).otherwise(base)


def age_days(at: Column, now: datetime) -> Column:
    """Age in days with fractions."""
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decay_fraction(age: Column, schedule: Sequence[tuple[int, float]] = SCHEDULE) -> Column:
    """The share left at an age: of the steps reached (their bounds included) the last; 1 before the first, and for a null age."""
    c = F.lit(1.0)
    for days, share in schedule:
        c = F.when(age >= days, F.lit(share)).otherwise(c)
    return c


def decayed(weight: Column, source_type: Column, age: Column) -> Column:
    """A weight after decay, rounded half to even; weights of 0 or less, and null ones, give 0."""
    left = F.bround(weight * decay_fraction(age), 0).cast("long")
    return F.when(F.coalesce(weight, F.lit(0)) <= 0, F.lit(0).cast("long")).when(source_type.isin(*NEVER_DECAYS), weight.cast("long")).otherwise(F.greatest(left, F.lit(0).cast("long")))


def decayed_confidence(evidence: DataFrame, now: datetime) -> DataFrame:
    """device_id, base, confidence, pieces: a device's evidence as it was weighted, and as it counts now."""
    return evidence.groupBy("device_id").agg(F.sum("weight").alias("base"), F.sum(decayed(F.col("weight"), F.col("source_type"), age_days(F.col("first_seen"), now))).alias("confidence"), F.count("*").alias("pieces"))


def deduplicated(ledger: DataFrame) -> DataFrame:
    """Ledger entries of which the first for a device, evidence and rule counts; entries without evidence all count."""
    w = Window.partitionBy("device_id", "evidence_id", "rule").orderBy("line", "points")
    return ledger.withColumn("_n", F.row_number().over(w)).where("_n = 1 or evidence_id is null").drop("_n")


def running(ledger: DataFrame) -> DataFrame:
    """Each entry with the device's confidence before and after it."""
    w = Window.partitionBy("device_id").orderBy("evidence_id", "line", "rule", "points").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum("points").over(w)
    return ledger.withColumn("new_confidence", after).withColumn("previous_confidence", F.col("new_confidence") - F.col("points"))


def with_reversals(ledger: DataFrame, invalid: Column) -> DataFrame:
    """The ledger with a compensating entry for each one that became invalid: nothing is ever deleted."""
    back = ledger.where(invalid).withColumn("rule", F.concat(F.lit("invalidate:"), F.col("rule"))).withColumn("points", -F.abs("points"))
    return ledger.unionByName(back)


def drift(ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """device_id, ledger_total, stored, drift: where the sum of a device's entries and its stored confidence differ, from either side."""
    total = ledger.groupBy("device_id").agg(F.sum("points").alias("ledger_total"))
    both = total.join(stored, "device_id", "full_outer").select("device_id", F.coalesce("ledger_total", F.lit(0)).alias("ledger_total"), F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.withColumn("drift", F.col("ledger_total") - F.col("stored")).where("drift <> 0")
