"""What a model number tells of a device, by rules: maker by prefix, series and tier by pattern, region by ending. Unknown stays null."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    """A maker's rules. prefixes: of model numbers; series: pattern, family and tier, the first that matches counts; regions: last letter and what it stands for."""

    prefixes: Sequence[str] = ()
    series: Sequence[tuple[str, str, str | None]] = ()
    regions: dict[str, str] = field(default_factory=dict)
    flagship_month: int | None = None


# What is known of the makers; the order is that in which prefixes are tried.
PROFILES = {
    "samsung": Profile(
        ("SM-S", "SM-F", "SM-A", "SM-M", "SM-G"),
        ((r"^SM-S9[0-9]{2}", "Galaxy S", "flagship"), (r"^SM-F9[0-9]{2}", "Galaxy Z", "flagship_foldable"), (r"^SM-A[0-9]{2}", "Galaxy A", "midrange"), (r"^SM-M[0-9]{2}", "Galaxy M", "budget")),
        {"B": "global_or_india", "U": "usa", "N": "korea", "W": "canada", "0": "china", "E": "europe_variant", "J": "japan", "Z": "other"}, 1,
    ),
    "google": Profile(("G", "Pixel"), ((r"(?i)pixel\s?\d+\s?pro", "Pixel", "flagship"), (r"(?i)pixel\s?\d+a", "Pixel", "midrange")), {}, 8),
    "oneplus": Profile(("CPH", "PLK"), ((r"(?i)oneplus\s?\d+", "OnePlus", "flagship"), (r"(?i)oneplus\s?nord", "Nord", "midrange")), {}, None),
}


def inferred_maker(model: Column, profiles: dict[str, Profile] = PROFILES) -> Column:
    """The first maker, in the profiles' order, of whose prefixes a model number has one."""
    c = F.lit(None).cast("string")
    for maker, p in reversed(profiles.items()):
        hit = F.lit(False)
        for x in p.prefixes:
            hit = hit | F.upper(model).startswith(x.upper())
        c = F.when(hit, F.lit(maker)).otherwise(c)
    return c


def enriched(df: DataFrame, model: str, maker: str, marketing: str, profiles: dict[str, Profile] = PROFILES) -> DataFrame:
    """Adds known: maker (given or inferred), family, tier, region, launch_month (of flagships) and confidence (low, medium, high by how many are known)."""
    m, name = F.trim(F.col(model)), F.coalesce(F.col(marketing), F.lit(""))
    df = df.withColumn("_maker", F.coalesce(F.lower(F.col(maker)), inferred_maker(m, profiles)))
    family = tier = region = F.lit(None).cast("string")
    month = F.lit(None).cast("int")
    for who, p in profiles.items():
        mine = F.col("_maker") == who
        for pattern, f, t in reversed(p.series):
            hit = mine & (m.rlike(pattern) | name.rlike(pattern))
            family, tier = F.when(hit, F.lit(f)).otherwise(family), F.when(hit, F.lit(t)).otherwise(tier)
        if p.regions:
            ends = F.create_map(*[F.lit(x) for kv in p.regions.items() for x in kv])[F.regexp_extract(F.upper(m), r"[0-9]([A-Z0-9])$", 1)]
            region = F.when(mine, ends).otherwise(region)
        if p.flagship_month:
            month = F.when(mine, F.lit(p.flagship_month)).otherwise(month)
    df = df.withColumn("_f", family).withColumn("_t", tier).withColumn("_r", region)
    signals = F.col("_f").isNotNull().cast("int") + F.col("_t").isNotNull().cast("int") + F.col("_r").isNotNull().cast("int")
    confidence = F.when(signals >= 3, "high").when(signals >= 1, "medium").otherwise("low")
    known = F.struct(F.col("_maker").alias("maker"), F.col("_f").alias("family"), F.col("_t").alias("tier"), F.col("_r").alias("region"), F.when(F.col("_t") == "flagship", month).alias("launch_month"), confidence.alias("confidence"))
    return df.withColumn("known", known).drop("_maker", "_f", "_t", "_r")


def filled_once(df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the first value of each column that isn't null, in order: what is known once isn't overwritten."""
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("_v"))))["_v"].alias(c) for c in columns]
    return df.groupBy(*key).agg(*first)
