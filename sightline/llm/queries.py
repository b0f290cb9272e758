"""Queries of the llm problems, over whole tables. None has SQL: tests/llm holds them against brute force, round trips and labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm.canonical import canonical_values
from sightline.llm.mixing import mixed
from sightline.llm.packing import fill_report, packed
from sightline.llm.pages import main_body, residue
from sightline.llm.quantiles import combined, daily_summaries, percentiles
from sightline.llm.sentences import sentences
from sightline.queries.registry import Registry
from sightline.sources.tables import table

LLM = Registry()


@LLM.add()
def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each collector's durations and finds, with the error bound of each: daily summaries, merged over all days."""
    return percentiles(combined(daily_summaries(table(spark, sf_dir, "collector_run_metrics"))))


@LLM.add()
def p2_daily_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily summaries themselves, in the form that combines over days."""
    return daily_summaries(table(spark, sf_dir, "collector_run_metrics"))


@LLM.add()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each page's main body."""
    return main_body(table(spark, sf_dir, "snapshots"))


@LLM.add()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that hold template residue, filler or error text where product information should be."""
    return residue(table(spark, sf_dir, "snapshots")).select("id")


@LLM.add()
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed model that each sighting's identifier denotes, or `unmatched`."""
    return canonical_values(*(table(spark, sf_dir, t) for t in ("discovery_results", "model_validations", "devices", "aliases")))


@LLM.add()
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each document, or piece of a longer one, in every pack."""
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities"))


@LLM.add()
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each pack are."""
    return fill_report(packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacities")), table(spark, sf_dir, "pack_capacities"))


@LLM.add()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of each mix and the number of times each is used."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@LLM.add()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of tokens that each source reaches in each mix."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@LLM.add()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of each document ends."""
    return sentences(table(spark, sf_dir, "documents"))
