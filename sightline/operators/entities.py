"""Resolving sightings to devices, families and aliases."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import stripped

#: Fixed value: endings of a model number that tell a region, not a model.
REGIONAL_SUFFIXES = "BUNWEJZ0"


def normal_model(model: Column) -> Column:
    """Upper case, without blanks and hyphens."""
    return F.translate(F.upper(F.trim(model)), " -", "")


def family_key(model: Column) -> Column:
    """A model number without its regional ending: one letter of REGIONAL_SUFFIXES after a digit, if more than three characters stay."""
    m = normal_model(model)
    return F.when(F.length(m) > 4, F.regexp_replace(m, rf"(?<=[0-9])[{REGIONAL_SUFFIXES}]$", "")).otherwise(m)


def variants(devices: DataFrame, manufacturer: str, model: str, order: Sequence[str]) -> DataFrame:
    """Adds family_key, is_variant and parent: within a maker and family the first arrival is the parent, later ones are its variants."""
    w = Window.partitionBy(manufacturer, "family_key").orderBy(*order)
    df = devices.withColumn("family_key", family_key(F.col(model)))
    return df.withColumn("is_variant", F.row_number().over(w) > 1).withColumn("parent", F.first(model).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def first_owner(aliases: DataFrame, key: Sequence[str], owner: str, order: Sequence[str]) -> DataFrame:
    """Of each alias the first claim, which keeps it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return aliases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflicts(aliases: DataFrame, key: Sequence[str], owner: str) -> DataFrame:
    """Aliases that several owners claim, with how many and who."""
    return aliases.groupBy(*key).agg(F.countDistinct(owner).alias("owners"), F.array_join(F.array_sort(F.collect_set(owner)), ",").alias("claimed_by")).where("owners > 1")


def lookup_alias(aliases: DataFrame, asked: DataFrame, value: str = "value", key: str = "asked") -> DataFrame:
    """asked, device_id, how: an alias looked up by its exact value first, then regardless of case; of several the one with the least device_id."""
    a = aliases.select(F.col("device_id"), stripped(F.col(value)).alias("_v"))
    q = asked.select(F.col(key).alias("asked"))
    hits = q.join(a, F.lower(q["asked"]) == F.lower(a["_v"])).withColumn("_rank", F.when(F.col("asked") == F.col("_v"), 0).otherwise(1))
    best = hits.groupBy("asked").agg(F.min(F.struct("_rank", "device_id")).alias("b"))
    return best.select("asked", F.col("b.device_id").alias("device_id"), F.when(F.col("b._rank") == 0, "exact").otherwise("folded").alias("how"))


KEPT = "device_id string, source string, ordinal long, new_evidence boolean"


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which records are new evidence, in order of arrival within a device and source: not those whose hash is among the kept ones', nor those whose URL
    is kept with an equal hash, or one of the two unknown. Rows come sorted, so what is kept of one group is all that is held."""
    group, hashes, by_url = None, set(), {}  # by_url: URL -> hashes of the kept records
    for rows in parts:
        new = []
        for d, s, h, u in zip(rows["device_id"], rows["source"], rows["content_hash"], rows["url"], strict=True):
            if (d, s) != group:
                group, hashes, by_url = (d, s), set(), {}
            h, u = (None if pd.isna(x) else x for x in (h, u))
            seen = (h is not None and h in hashes) or (u is not None and u in by_url and (h is None or None in by_url[u] or h in by_url[u]))
            new.append(not seen)
            if not seen:
                if h is not None:
                    hashes.add(h)
                if u is not None:
                    by_url.setdefault(u, set()).add(h)
        yield rows[["device_id", "source", "ordinal"]].assign(new_evidence=new)


def evidence_dedup(records: DataFrame) -> DataFrame:
    """device_id, source, ordinal, new_evidence: which records are evidence of their own, and which only see known evidence again.

    The rule depends on order and an unknown hash equals any, so groups (of one device and source) with records of both kinds are folded in
    order. Groups whose hashes are all known, and those whose hashes are all unknown, need no order but the first of each hash or URL: these
    stay in the JVM, however large they are. Of equal hash and URL only the first record is ever folded.
    """
    r = records.select(F.col("device_id").cast("string").alias("device_id"), F.coalesce("source", F.lit("")).alias("source"), F.col("ordinal").cast("long").alias("ordinal"), "content_hash", "url")
    group = r.groupBy("device_id", "source").agg(F.count("*").alias("_n"), F.count("content_hash").alias("_h"))
    r = r.join(group, ["device_id", "source"])
    by_hash = Window.partitionBy("device_id", "source", "content_hash").orderBy("ordinal")
    by_url = Window.partitionBy("device_id", "source", "url").orderBy("ordinal")
    known = r.where("_h = _n").select("device_id", "source", "ordinal", (F.row_number().over(by_hash) == 1).alias("new_evidence"))
    unknown = r.where("_h = 0").select("device_id", "source", "ordinal", (F.col("url").isNull() | (F.row_number().over(by_url) == 1)).alias("new_evidence"))
    same = Window.partitionBy("device_id", "source", "content_hash", "url").orderBy("ordinal")
    rest = r.where("_h > 0 and _h < _n").withColumn("_first", (F.row_number().over(same) == 1) | (F.col("content_hash").isNull() & F.col("url").isNull()))
    again = rest.where("not _first").select("device_id", "source", "ordinal", F.lit(False).alias("new_evidence"))
    key = ["device_id", "source"]
    mixed = rest.where("_first").repartition(*key).sortWithinPartitions(*key, "ordinal").select(*key, "ordinal", "content_hash", "url").mapInPandas(_fold, KEPT)
    return known.unionByName(unknown).unionByName(again).unionByName(mixed)
