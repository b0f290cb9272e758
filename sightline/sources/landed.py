"""Rows from landed files: fetched pages and sitemaps, fetch logs, and files of the usual formats."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions.url import host, normal_url
from sightline.operators.page_changes import has_any

SIGHTING = T.StructType(
    [T.StructField(n, t) for n, t in (("manufacturer", T.StringType()), ("model_number", T.StringType()), ("source", T.StringType()), ("source_type", T.StringType()), ("url", T.StringType()), ("content_hash", T.StringType()), ("discovered_at", T.TimestampType()))]
)
FORMATS = ("parquet", "orc", "json", "csv", "text", "xml", "avro")


def read(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str | None = None, **options: Any) -> DataFrame:
    """A table from files of one of FORMATS; broken records of a text format are nulls, not failures. Avro needs Spark's own avro module on the cluster."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    r = spark.read.format(fmt).options(**({"mode": "PERMISSIVE"} if fmt in ("json", "csv", "xml") else {}) | ({"header": True} if fmt == "csv" else {}) | options)
    return (r.schema(schema) if schema is not None else r).load(path)


def dimension(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A JSON object of objects as a table: each key with its fields as columns. Such files are configuration, so they are read on the driver."""
    rows = [{key: k, **v} for k, v in json.loads(Path(path).read_text()).items()]
    columns = [key, *sorted({c for r in rows for c in r} - {key})]
    return spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in rows], ", ".join(f"`{c}` string" for c in columns))


def overlaid(base: dict, over: dict) -> dict:
    """Settings with others laid over them, level by level."""
    return base | {k: overlaid(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml", keep: str | None = None) -> DataFrame:
    """Adds `loc` and `lastmod`, a row for each url element, with or without name spaces; a broken document still gives its whole elements. keep: a pattern that addresses must match."""
    prefix = r"(?:[A-Za-z0-9]+:)?"
    blocks = F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(rf"(?s)<{prefix}url>(.*?)</{prefix}url>"), F.lit(1))
    one = lambda b, tag: F.nullif(F.trim(F.regexp_extract(b, rf"(?s)<{prefix}{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{prefix}{tag}>", 1)), F.lit(""))
    df = sitemaps.withColumn("_b", F.explode(blocks)).withColumn("loc", F.replace(one(F.col("_b"), "loc"), F.lit("&amp;"), F.lit("&"))).withColumn("lastmod", one(F.col("_b"), "lastmod")).drop("_b").where("loc is not null")
    return df.where(F.col("loc").rlike(keep)) if keep else df


def novel_urls(listed: DataFrame, known: DataFrame, url: str = "loc") -> DataFrame:
    """Listed addresses that aren't known, compared without a slash at the end; each once."""
    bare = F.regexp_replace(F.col(url), "/+$", "")
    return listed.withColumn("_k", bare).join(known.select(F.regexp_replace(F.col(url), "/+$", "").alias("_k")), "_k", "left_anti").dropDuplicates(["_k"]).drop("_k")


def hrefs(pages: DataFrame, pattern: str, html: str = "html") -> DataFrame:
    """Adds `slug`: what the pattern's group takes from a page's addresses, each once a page."""
    return pages.withColumn("slug", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(pattern), F.lit(1))))))


def teasers(pages: DataFrame, pattern: str, words: Sequence[str], text: str = "text") -> DataFrame:
    """Adds `teaser`: what the pattern's group takes from those lines of a text that have one of the words."""
    line = F.explode(F.split(F.coalesce(text, F.lit("")), r"\r?\n"))
    df = pages.withColumn("_line", line).where(has_any(F.lower("_line"), tuple(words))).withColumn("teaser", F.regexp_extract("_line", pattern, 1))
    return df.where("teaser <> ''").drop("_line")


def mentions(pages: DataFrame, patterns: dict[str, str], least: int = 3, text: str = "text", distinct: bool = True) -> DataFrame:
    """manufacturer, model_number and the page's columns: model numbers in a text by each maker's pattern, in upper case, of `least` characters or more."""
    found = [
        F.transform(F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)), F.upper), lambda m: F.length(m) >= least), lambda m: F.struct(F.lit(k).alias("manufacturer"), m.alias("model_number")))
        for k, p in patterns.items()
    ]
    every = F.flatten(F.array(*found))
    return pages.withColumn("_m", F.explode(F.array_distinct(every) if distinct else every)).select("*", "_m.manufacturer", "_m.model_number").drop("_m")


def certifications(pages: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Mentions on certification pages, each model of a maker once, with a hash of the two as content."""
    m = mentions(pages, patterns, least=4, text=text).dropDuplicates(["manufacturer", "model_number"])
    return m.withColumn("content_hash", F.sha2(F.concat_ws(":", "manufacturer", "model_number"), 256))


def unusable(url: Column, text: Column, size: Column | None = None, most: int = 5_000_000) -> Column:
    """Why a response is no page to read: consent walls, robot checks, size; null if it is."""
    low = F.lower(F.coalesce(text, F.lit("")))
    c = F.when(host(url).startswith("consent."), "consent_page").when(low.contains("before you continue"), "consent_page").when(low.contains("captcha"), "captcha").when(low.contains("unusual traffic"), "unusual_traffic")
    return c.when((size if size is not None else F.octet_length(text)) > most, "response_too_large")


def with_fallback(primary: DataFrame, fallback: DataFrame, by: Sequence[str]) -> DataFrame:
    """primary, and of fallback the rows of those groups that primary has none of."""
    return primary.unionByName(fallback.join(primary.select(*by).distinct(), list(by), "left_anti").select(*primary.columns))


def fetch_metrics(log: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Requests, pages, failures, bytes and the histogram of statuses of a fetch log (columns status_code, bytes, error)."""
    total = log.groupBy(*by).agg(
        F.count("*").alias("http_requests"), F.count_if(F.col("status_code").between(200, 299)).alias("pages_fetched"), F.count_if(F.col("error").isNotNull() | (F.col("status_code") >= 400)).alias("http_failures"),
        F.count_if(F.col("error") == "timeout").alias("timeouts"), F.count_if(F.col("status_code").between(300, 399)).alias("redirects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_downloaded"),
    )
    codes = log.where("status_code is not null").groupBy(*by, "status_code").agg(F.count("*").alias("n")).groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("status_code").cast("string").alias("k"), "n")))).alias("status_counts"))
    return total.join(codes, list(by), "left")


def empty(spark: SparkSession) -> DataFrame:
    """A source that has nothing to give, by design."""
    return spark.createDataFrame([], SIGHTING)


def crawl_keys(urls: DataFrame, url: str = "loc") -> DataFrame:
    """Addresses in normal form, each once."""
    return urls.withColumn(url, normal_url(F.col(url))).dropDuplicates([url])
