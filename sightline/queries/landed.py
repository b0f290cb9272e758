"""Queries on pages as they were landed: links, mentions, teasers, certifications, unusable responses, fallbacks and the log of fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.queries.registry import Registry
from sightline.sources import landed as L
from sightline.sources import views as V
from sightline.sources.tables import table

LANDED = Registry()
#: Model codes by maker, as they stand in texts.
CODES = {"samsung": r"(?i)\b(SM-[A-Z0-9]{3,16})\b", "oneplus": r"(?i)\b(CPH[0-9]{4}|PLK[0-9]{4})\b", "google": r"(?i)\b(GP[0-9]{4}[A-Z]?)\b", "xiaomi": r"(?i)\b(M[0-9]{4}[A-Z][0-9A-Z]{1,4})\b"}
#: A word ends at any letter's end, in all scripts; in the SQL's patterns \\b knows the letters of English alone.
EDGE_SQL = r"[^\p{L}\p{N}_]"
CODES_SQL = " union all ".join(f"select *, '{m}' manufacturer, regexp_extract_all(t, '{p.replace(chr(92) + 'b(', f'(?:^|{EDGE_SQL})(').replace(')' + chr(92) + 'b', f')(?:$|{EDGE_SQL})')}', 1) found from p" for m, p in CODES.items())


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL}, s as (select distinct id, unnest(list_distinct(regexp_extract_all(content, 'href=[''"]/p/([0-9]+)[''"]', 1))) slug from snaps where content is not null)
select slug, count(*) pages from s group by 1"""
)
def q65_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product links in fetched pages, and on how many pages each stands."""
    return L.hrefs(V.snapshots(spark, sf_dir, "content"), r"""href=['"]/p/([0-9]+)['"]""", "content").groupBy("slug").agg(F.count("*").alias("pages"))


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL}, p as (select id, coalesce(content, '') t from snaps), f as ({CODES_SQL}),
m as (select distinct id, manufacturer, unnest(list_transform(found, lambda x: upper(x))) model_number from f)
select manufacturer, model_number, count(*) pages from m group by 1, 2"""
)
def q66_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model codes that fetched pages mention, each once a page."""
    return L.mentions(V.snapshots(spark, sf_dir, "content"), CODES, text="content").groupBy("manufacturer", "model_number").agg(F.count("*").alias("pages"))


@LANDED.add(
    rf"""with p as (select coalesce(raw_reference, '') t from discovery_results), f as ({CODES_SQL}), m as (select distinct manufacturer, unnest(list_transform(found, lambda x: upper(x))) model_number from f)
select manufacturer, model_number, sha256(manufacturer || ':' || model_number) content_hash from m where length(model_number) >= 4"""
)
def q67_certifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model that references name, once, with the hash that stands for it."""
    return L.certifications(table(spark, sf_dir, "discovery_results", "raw_reference"), CODES, "raw_reference").select("manufacturer", "model_number", "content_hash")


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL} select source, reason, count(*) n from (select source, case when contains(lower(coalesce(content, '')), 'before you continue') then 'consent_page' when contains(lower(coalesce(content, '')), 'captcha') then 'captcha'
  when contains(lower(coalesce(content, '')), 'unusual traffic') then 'unusual_traffic' when strlen(content) > 2000 then 'response_too_large' end reason from snaps) where reason is not null group by 1, 2"""
)
def q68_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are no pages to read, by source and reason; here beyond 2,000 bytes a page counts as too large."""
    s = V.snapshots(spark, sf_dir, "source", "url", "content").withColumn("reason", L.unusable(F.col("url"), F.col("content"), most=2000))
    return s.where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL}, a as (select id, source, title from snaps where content is not null and status_code = 200), b as (select id, source, title from snaps where content is null and title is not null and source not in (select source from a where source is not null))
select source, count(*) n, count(title) titled from (select * from a union all select * from b) group by 1"""
)
def q69_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored, and for sources that stored none their titles alone."""
    s = V.snapshots(spark, sf_dir, "source", "title", "content", "status_code")
    rows = L.with_fallback(s.where("content is not null and status_code = 200").select("id", "source", "title"), s.where("content is null and title is not null").select("id", "source", "title"), ["source"])
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("title").alias("titled"))


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL}, l as (select source, status_code, cast(content_length as bigint) bytes, case when status_code >= 500 then 'timeout' end error from snaps),
c as (select source, string_agg(status_code || '=' || n, ';' order by status_code::varchar) status_counts from (select source, status_code, count(*) n from l where status_code is not null group by 1, 2) group by 1)
select source, count(*) http_requests, count(*) filter (status_code between 200 and 299) pages_fetched, count(*) filter (error is not null or status_code >= 400) http_failures, count(*) filter (error = 'timeout') timeouts,
  count(*) filter (status_code between 300 and 399) redirects, cast(coalesce(sum(bytes), 0) as bigint) bytes_downloaded, status_counts from l left join c using (source) group by source, status_counts"""
)
def q70_fetch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, failures, bytes and statuses of each source's fetches."""
    log = V.snapshots(spark, sf_dir, "source", "status_code", "content_length").select("source", "status_code", F.col("content_length").cast("long").alias("bytes"), F.when(F.col("status_code") >= 500, "timeout").alias("error"))
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("status_counts")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return L.fetch_metrics(log).withColumn("status_counts", counts)


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL}, l as (select id, unnest(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))) line from snaps where content is not null),
t as (select regexp_extract(line, '<h1>([^<]*)</h1>', 1) teaser from l where contains(lower(line), 'pro') or contains(lower(line), 'ultra'))
select teaser, count(*) pages from t where teaser <> '' group by 1"""
)
def q71_teasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that announce a model of the upper tiers."""
    return L.teasers(V.snapshots(spark, sf_dir, "content"), "<h1>([^<]*)</h1>", ("pro", "ultra"), "content").groupBy("teaser").agg(F.count("*").alias("pages"))


@LANDED.add(
    rf"""with {V.SNAPSHOTS_SQL} select source, count(distinct url) urls from snaps where url is not null and contains(url, '/support/') group by 1"""
)
def q72_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The support pages that each source's sitemaps list, of one sitemap for each fetch."""
    s = V.snapshots(spark, sf_dir, "source", "url").where("url is not null")
    text = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    maps = s.select("source", F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>'), text, F.lit("</loc></url><url><loc></loc></url></urlset>")).alias("xml"))
    return L.sitemap_urls(maps, keep="/support/").groupBy("source").agg(F.countDistinct("loc").alias("urls"))


@LANDED.add(
    """with a as (select distinct manufacturer, lower(value) v from aliases where value is not null), c as (select manufacturer, lower(canonical_model) v from model_validations)
select 'union' op, count(*) n from (select * from a union select * from c) union all select 'intersect', count(*) from (select * from a intersect select * from c) union all select 'except', count(*) from (select * from a except select * from c)"""
)
def q73_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What aliases and the reference list have in all, in common, and aliases alone."""
    a = table(spark, sf_dir, "aliases", "manufacturer", "value").where("value is not null").select("manufacturer", F.lower("value").alias("v"))
    c = table(spark, sf_dir, "model_validations", "manufacturer", "canonical_model").select("manufacturer", F.lower("canonical_model").alias("v"))
    every = [("union", a.union(c).distinct()), ("intersect", a.intersect(c)), ("except", a.subtract(c))]
    out = [d.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, d in every]
    return out[0].union(out[1]).union(out[2])


@LANDED.add(
    rf"""with {V.RUNS_SQL} select run_id, rank() over w rnk, dense_rank() over w dense, round(percent_rank() over w, 6) pct, ntile(4) over o fourth, nth_value(run_id, 3) over (o rows between unbounded preceding and unbounded following) third
from runs where candidates_found is not null window w as (partition by collector order by candidates_found desc), o as (partition by collector order by candidates_found desc, run_id)"""
)
def q74_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each run stands among its collector's by what it found."""
    r = V.runs(spark, sf_dir).where("candidates_found is not null")
    w = Window.partitionBy("collector").orderBy(F.desc("candidates_found"))
    o = Window.partitionBy("collector").orderBy(F.desc("candidates_found"), "run_id")
    whole = o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return r.select("run_id", F.rank().over(w).cast("long").alias("rnk"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.ntile(4).over(o).cast("long").alias("fourth"), F.nth_value("run_id", 3).over(whole).alias("third"))


@LANDED.add(
    """with d as (select result_id, manufacturer, source, discovered_at from discovery_results where discovered_at is not null)
select cast(date_trunc('day', discovered_at) as timestamp) "day", source, count(*) n, count(distinct manufacturer) manufacturers from d group by 1, 2 order by 1, n desc, 2"""
)
def q75_daily_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings a day and source, in order of days and counts."""
    d = table(spark, sf_dir, "discovery_results", "manufacturer", "source", "discovered_at").where("discovered_at is not null")
    return d.groupBy(F.date_trunc("day", "discovered_at").alias("day"), "source").agg(F.count("*").alias("n"), F.countDistinct("manufacturer").alias("manufacturers")).orderBy("day", F.desc("n"), "source")
