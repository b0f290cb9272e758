"""Queries on fetched pages, their addresses and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.html import dom_signature, page_parts
from sightline.functions.text import stripped
from sightline.functions.url import asset_url, file_name, host, normal_url
from sightline.operators import identifiers as I
from sightline.operators import page_changes as P
from sightline.operators.enrichment import enriched, filled_once
from sightline.operators.upsert import first_of, retained, synchronised, upserted
from sightline.queries.registry import Registry
from sightline.sources import views as V
from sightline.sources.tables import table

PAGES = Registry()
HEAD_SQL = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"
PATH_SQL = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
NORMAL_SQL = rf"lower({HEAD_SQL}) || regexp_replace({PATH_SQL}, '/+$', '') || coalesce('?' || nullif(array_to_string(list_filter(string_split({QUERY_SQL}, '&'), lambda p: p <> '' and not starts_with(p, 'utm_')), '&'), ''), '')"
TRACKING_SQL = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'mc_cid', 'mc_eid', '_ga', 'sessionid', 'sid', 'token', 'csrf', 'csrf_token'"


@PAGES.add(
    rf"""with {V.SNAPSHOTS_SQL} select id, {NORMAL_SQL} page_url,
  {HEAD_SQL} || {PATH_SQL} || coalesce('?' || nullif(array_to_string(list_filter(string_split({QUERY_SQL}, '&'), lambda p: contains(p, '=') and not ends_with(p, '=') and lower(split_part(p, '=', 1)) not in ({TRACKING_SQL})), '&'), ''), '') asset_url,
  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)', 1)) host, nullif(split_part(regexp_replace({PATH_SQL}, '/+$', ''), '/', -1), '') file_name from snaps"""
)
def q35_url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in their normal forms, their host and file."""
    u = F.col("url")
    return V.snapshots(spark, sf_dir, "url").select("id", normal_url(u).alias("page_url"), asset_url(u).alias("asset_url"), host(u).alias("host"), file_name(u).alias("file_name"))


@PAGES.add(
    rf"""with {V.SNAPSHOTS_SQL}, t as (select id, content, list_slice(regexp_extract_all(lower(content), '<(h1|h2|h3|a|img|table|ul|ol|section|article)[\s>/]', 1), 1, 500) tags from snaps where content is not null)
select id, case when len(tags) > 0 then sha256(array_to_string(tags, '|')) end dom_hash, case when content <> '' then sha256(regexp_replace(content, '\s+', ' ', 'g')) end content_hash from t"""
)
def q36_dom_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of each page's structure and of its content regardless of layout."""
    s = V.snapshots(spark, sf_dir, "content").where("content is not null")
    return s.select("id", P.sha(dom_signature(F.col("content"))).alias("dom_hash"), P.sha(F.regexp_replace("content", r"\s+", " ")).alias("content_hash"))


@PAGES.add()
def q37_visible_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, hash and length of each page's visible text, without noise; read by the parser."""
    s = V.snapshots(spark, sf_dir, "content").where("content is not null").select("id", page_parts(F.col("content")).alias("p"))
    return s.select("id", F.col("p.title").alias("title"), P.sha(F.regexp_replace("p.text", r"\s+", " ")).alias("text_hash"), F.coalesce(F.length("p.text"), F.lit(0)).alias("text_length"))


@PAGES.add(
    f"""with {V.SNAPSHOTS_SQL}, p as (select id, source, {NORMAL_SQL} page, content, fetched_at from snaps where content is not null),
l as (select id, list_distinct(list_filter(string_split(content, chr(10)), lambda x: x <> '')) new, list_distinct(list_filter(string_split(lag(content) over (partition by source, page order by fetched_at, id), chr(10)), lambda x: x <> '')) old from p)
select id, cast(len(list_filter(new, lambda x: not list_contains(old, x))) as integer) added_lines, cast(len(list_filter(old, lambda x: not list_contains(new, x))) as integer) removed_lines from l where old is not null"""
)
def q38_line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different lines a fetch added to and removed from the one before of the same page."""
    s = V.snapshots(spark, sf_dir, "source", "url", "content", "fetched_at").where("content is not null").withColumn("page", normal_url(F.col("url")))
    before = s.withColumn("_old", F.lag("content").over(Window.partitionBy("source", "page").orderBy("fetched_at", "id"))).where("_old is not null")
    return before.select("id", P.lines_added(F.col("content"), F.col("_old")).alias("added_lines"), P.lines_added(F.col("_old"), F.col("content")).alias("removed_lines"))


@PAGES.add()
def q39_change_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed from each page's last successful fetch, whether that means anything, and its score."""
    s = V.snapshots(spark, sf_dir, "source", "url", "content", "fetched_at", "status_code").where("content is not null").withColumn("url", normal_url(F.col("url")))
    h = P.page_history(P.fingerprints(s))
    return h.select("id", F.array_join("change.classes", ",").alias("classes"), F.col("change.meaningful").alias("meaningful"), F.col("change.score").alias("score"))


@PAGES.add(
    r"""select result_id, array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(t, '(?i)\b(SM-[A-Z0-9]{4,10})\b', 1), regexp_extract_all(t, '(?i)\b(CPH\d{4})\b', 1), regexp_extract_all(t, '(?i)\b(G[A-Z0-9]{6,12})\b', 1), regexp_extract_all(t, '(?i)\b(A0\d{2}|A1\d{2})\b', 1)), lambda x: true))), ',') models
from (select result_id, raw_reference t from discovery_results where raw_reference is not null) where models <> ''"""
)
def q40_model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model codes in each sighting's reference."""
    d = table(spark, sf_dir, "discovery_results", "result_id", "raw_reference").where("raw_reference is not null")
    found = F.flatten(F.array(*[F.regexp_extract_all("raw_reference", F.lit(p), F.lit(1)) for p in P.MODELS[:4]]))
    return d.select("result_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("models")).where("models <> ''")


@PAGES.add()
def q63_all_model_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model codes and names in each sighting's reference: all patterns, of which q40 and its SQL have the four of codes."""
    d = table(spark, sf_dir, "discovery_results", "result_id", "raw_reference").where("raw_reference is not null")
    return d.select("result_id", F.array_join(P.model_references(F.col("raw_reference")), ",").alias("models")).where("models <> ''")


WORDS_SQL = "'" + "', '".join(I.STOP_WORDS) + "'"
REJECT_SQL = (
    "case when t = '' then 'empty_field' when length(t) > 40 then 'too_long' "
    + " ".join(f"when {' or '.join(f'contains(lower(t), $${w}$$)' for w in words)} then '{reason}'" for reason, words in I.NOT_IDENTIFIERS)
    + rf" when len(list_filter(regexp_extract_all(lower(t), '([a-z'']+)', 1), lambda w: w in ({WORDS_SQL}))) > 1 or len(regexp_extract_all(lower(t), '([a-z'']+)', 1)) > 6 then 'contains_sentence' end"
)


@PAGES.add(f"select source, reason, count(*) n from (select source, {REJECT_SQL} reason from (select source, trim(coalesce(candidate_identifier, '')) t from discovery_results)) where reason is not null group by 1, 2")
def q41_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source's identifiers can't be any, and why."""
    d = table(spark, sf_dir, "discovery_results", "source", "candidate_identifier").withColumn("reason", I.rejected(F.col("candidate_identifier")))
    return d.where("reason is not null").groupBy("source", "reason").agg(F.count("*").alias("n"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rule_sql(maker: str) -> str:
    """The number of the first rule of a maker's grammar that holds for the text t."""
    whens = [f"when {f'regexp_matches(t, {_quoted(r.form)})' if r.form else 'true'}{f' and (length(t) < {r.lengths[0]} or length(t) > {r.lengths[1]})' if r.lengths else ''} then {n}" for n, r in enumerate(I.rules_of(maker))]
    return f"case {' '.join(whens)} end"


def _by_rule_sql(value) -> str:
    return "case " + " ".join(f"when m = '{maker}' and n = {n} then {value(r)}" for maker in I.GRAMMARS for n, r in enumerate(I.rules_of(maker))) + " end"


def _family_sql(r) -> str:
    if r.reason or not r.family:
        return "null"
    if not r.family.startswith("{"):
        return f"'{r.family}'"
    told = f"regexp_extract(t, {_quoted(r.form)}, 1)"
    return f"upper({told}) || '-series'" if r.family.startswith("{upper") else f"array_to_string(list_transform(string_split(lower({told}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"


GRAMMAR_SQL = (
    "with d as (select manufacturer, lower(manufacturer) m, trim(coalesce(candidate_identifier, '')) t from discovery_results), "
    f"w as (select *, {REJECT_SQL} why from d), "
    f"r as (select *, case {' '.join(f'when m = $${k}$$ then {_rule_sql(k)}' for k in I.GRAMMARS)} end n from w), "
    f"o as (select manufacturer, case when n is null then 'unknown_manufacturer' when why is not null then why else {_by_rule_sql(lambda r: f'$${r.reason}$$' if r.reason else 'null')} end reason, case when n is not null and why is null then {_by_rule_sql(_family_sql)} end family from r) "
)


@PAGES.add(
    GRAMMAR_SQL + "select manufacturer, case when reason is null then 'VALID' when starts_with(reason, 'unrecognized_') then 'AMBIGUOUS' else 'INVALID' end outcome, reason, family, count(*) n from o group by 1, 2, 3, 4"
)
def q42_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the makers' grammars on all sightings."""
    d = I.validated_by_maker(table(spark, sf_dir, "discovery_results", "candidate_identifier", "manufacturer"), "candidate_identifier", "manufacturer")
    return d.groupBy("manufacturer", F.col("validation.outcome").alias("outcome"), F.col("validation.reason").alias("reason"), F.col("validation.family").alias("family")).agg(F.count("*").alias("n"))


@PAGES.add()
def q64_slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each page of a maker is about, by the last part of its address."""
    s = table(spark, sf_dir, "snapshots", "url", "manufacturer").where("url is not null and manufacturer is not null").select(F.lower("manufacturer").alias("maker"), normal_url(F.col("url")).alias("url")).distinct()
    s = s.withColumn("slug", F.regexp_replace(F.regexp_extract("url", r"/([^/?#]+)(?:[?#].*)?$", 1), "-[0-9a-f]{4,}$", ""))
    family = F.when(F.col("maker") == "oppo", F.regexp_extract("slug", "^(?:oppo-)?(find-[xn]|reno|a)(?=[0-9])", 1)).otherwise(F.regexp_extract("slug", "^(razr|moto-g|moto-e|motorola-edge)", 1))
    c = F.lit(None).cast("string")
    for maker in ("google", "oneplus", "nothing", "xiaomi", "honor", "realme", "oppo", "motorola"):
        slug = F.translate("slug", "-", "_") if maker == "google" else F.col("slug")
        c = F.when(F.col("maker") == maker, I.slug_name(slug, maker, family)).otherwise(c)
    return s.select("maker", "slug", c.alias("name")).where("slug <> ''").groupBy("maker", "slug", "name").agg(F.count("*").alias("pages"))


@PAGES.add(
    r"""with s as (select result_id, replace(upper(trim(candidate_identifier)), ' ', '') t from discovery_results where upper(trim(candidate_identifier)) like 'SM%'),
p as (select result_id, t, regexp_extract(regexp_extract(t, '^([^/,_]*)', 1), '^(SM-[SAGMFECTWXRVL][0-9]{2,4})([A-Z0-9]{0,10})$', 1) base, regexp_extract(regexp_extract(t, '^([^/,_]*)', 1), '^(SM-[SAGMFECTWXRVL][0-9]{2,4})([A-Z0-9]{0,10})$', 2) rest from s)
select result_id, base || case when left(rest, 1) in ('B', 'U', 'N', 'W', '0', 'E', 'J') and not starts_with(rest, 'U1') then left(rest, 1) else '' end canonical, 'SM' || substr(base, 4) family_key from p where base <> '' and base[4] not in ('L', 'R')"""
)
def q43_samsung_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of one maker taken apart."""
    d = table(spark, sf_dir, "discovery_results", "result_id", "candidate_identifier").where(F.upper(stripped(F.col("candidate_identifier"))).startswith("SM"))
    return d.select("result_id", I.samsung_model(F.col("candidate_identifier")).alias("m")).where("m.reason is null").select("result_id", "m.canonical", "m.family_key")


@PAGES.add(f"with {V.SNAPSHOTS_SQL}, p as (select *, {NORMAL_SQL} page from snaps) select id from (select id, row_number() over (partition by source, page order by fetched_at desc nulls last, id desc) n from p) where n <= 3")
def q44_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetches that stay if each page keeps its last three."""
    s = V.snapshots(spark, sf_dir, "source", "url", "fetched_at").withColumn("page", normal_url(F.col("url")))
    return retained(s, ["source", "page"], [F.desc_nulls_last("fetched_at"), F.desc("id")], 3).select("id")


@PAGES.add(
    f"""with {V.SNAPSHOTS_SQL}, p as (select *, {NORMAL_SQL} page from snaps), m as (select max(sweep_no) s from p), k as (select distinct source, page from p, m where sweep_no < s), l as (select distinct source, page from p, m where sweep_no = s)
select coalesce(k.source, l.source) source, coalesce(k.page, l.page) page, l.page is not null active, k.page is null novel from k full join l on k.source = l.source and k.page = l.page"""
)
def q45_sitemap_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known pages against those of the latest sweep: gone ones are inactive, new ones are added."""
    s = V.snapshots(spark, sf_dir, "source", "url", "sweep_no").select("source", normal_url(F.col("url")).alias("page"), "sweep_no")
    last = s.agg(F.max("sweep_no")).scalar()
    k = s.where(F.col("sweep_no") < last).select("source", "page", F.concat_ws("\n", "source", "page").alias("k")).distinct()
    listed = s.where(F.col("sweep_no") == last).select("source", "page", F.concat_ws("\n", "source", "page").alias("k")).distinct()
    known = synchronised(k, listed, "k").withColumn("novel", F.lit(False))
    fresh = listed.join(k.select("k"), "k", "left_anti").withColumn("active", F.lit(True)).withColumn("novel", F.lit(True))
    return known.unionByName(fresh).select("source", "page", "active", "novel")


@PAGES.add(
    f"""with {V.SNAPSHOTS_SQL}, p as (select *, {NORMAL_SQL} page from snaps where status_code in (404, 410) or status_code between 200 and 299),
i as (select *, sum(case when status_code between 200 and 299 then 1 else 0 end) over (partition by source, page order by fetched_at, id rows unbounded preceding) g from p),
s as (select *, sum(case when status_code in (404, 410) then 1 else 0 end) over (partition by source, page, g order by fetched_at, id rows unbounded preceding) streak from i),
b as (select *, lag(streak) over (partition by source, page order by fetched_at, id) before from s)
select id, cast(streak as bigint) streak, case when streak = 3 and status_code in (404, 410) then 'PAGE_REMOVED' when status_code between 200 and 299 and before >= 3 then 'PAGE_RESTORED' end page_state from b"""
)
def q46_page_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that count as removed after three misses in a row, and their return."""
    s = V.snapshots(spark, sf_dir, "source", "url", "status_code", "fetched_at").withColumn("url", normal_url(F.col("url")))
    return P.removals(s).select("id", F.col("streak").cast("long").alias("streak"), "page_state")


@PAGES.add(
    """with d as (select manufacturer, source_url u, discovered_at, result_id from discovery_results where source_url is not null), a as (select *, row_number() over (partition by u order by discovered_at, result_id) n from d)
select u url, arg_min(manufacturer, n) filter (manufacturer is not null) manufacturer, count(*) seen, strftime(min(discovered_at), '%Y-%m-%d') first_seen, strftime(max(discovered_at), '%Y-%m-%d') last_seen from a group by u"""
)
def q47_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of sightings upserted into one table by URL: first non-null maker, counts added, first and last time."""
    d = table(spark, sf_dir, "discovery_results", "manufacturer", "source_url", "discovered_at", "result_id").where("source_url is not null")
    maker = F.min(F.when(F.col("manufacturer").isNotNull(), F.struct("discovered_at", "result_id", "manufacturer")))["manufacturer"]
    batch = lambda df: df.groupBy(F.col("source_url").alias("url")).agg(maker.alias("manufacturer"), F.count("*").alias("seen"), F.min("discovered_at").alias("first_seen"), F.max("discovered_at").alias("last_seen"))
    middle = d.agg(F.percentile_approx(F.unix_micros(F.col("discovered_at").cast("timestamp")), 0.5)).scalar()
    early = F.coalesce(F.unix_micros(F.col("discovered_at").cast("timestamp")) <= middle, F.lit(False))
    both = upserted(batch(d.where(early)), batch(d.where(~early)), ["url"], fill=["manufacturer"], add=["seen"], first=["first_seen"], last=["last_seen"])
    return both.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd"))


@PAGES.add("select url, source, fetched from (select url, source, count(*) over (partition by url) fetched, row_number() over (partition by url order by fetched_at nulls last, id) n from snapshots) where n = 1 and fetched > 1")
def q48_first_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fetch of each address that was fetched more than once."""
    s = table(spark, sf_dir, "snapshots", "id", "url", "source", "fetched_at")
    counts = s.groupBy("url").agg(F.count("*").alias("fetched")).where("fetched > 1")
    return first_of(s.join(counts, "url"), ["url"], [F.asc_nulls_last("fetched_at"), "id"]).select("url", "source", "fetched")


@PAGES.add(
    """with p as (select source, sweep_no, count(*) fetched, count(*) filter (status_code between 200 and 299) ok, count(*) filter (status_code = 404) missing, count(*) filter (content is null) unstored from snapshots group by 1, 2)
select source, sweep_no, fetched, ok, missing, unstored, round(100.0 * ok / fetched, 1)::double coverage_pct from p"""
)
def q49_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each sweep came through."""
    s = table(spark, sf_dir, "snapshots", "source", "sweep_no", "status_code", F.col("content").isNull().alias("_unstored"))
    g = s.groupBy("source", "sweep_no").agg(F.count("*").alias("fetched"), F.count_if(F.col("status_code").between(200, 299)).alias("ok"), F.count_if(F.col("status_code") == 404).alias("missing"), F.count_if("_unstored").alias("unstored"))
    return g.withColumn("coverage_pct", F.round((F.lit(100.0).cast("decimal(4,1)") * F.col("ok") / F.col("fetched")), 1).cast("double"))


@PAGES.add(
    """select id, status, k from (select event_id id, event_type status, cast(json_extract(props, '$.k') as bigint) k, ts, lag(ts) over (partition by user_id order by ts, event_id) before from events) where before is null or date_diff('microsecond', before, ts) > 3600000000"""
)
def q50_session_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after an hour of silence of the same user."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props", "ts").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("_gap", F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.where("_gap is null or _gap > 3600000000").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@PAGES.add(
    r"""with d as (select candidate_identifier m, manufacturer, candidate_marketing_name n from discovery_results where candidate_identifier is not null),
k as (select trim(m) m, coalesce(n, '') n, coalesce(lower(manufacturer), case when upper(trim(m)) similar to '(SM-S|SM-F|SM-A|SM-M|SM-G).*' then 'samsung' when upper(trim(m)) similar to '(G|PIXEL).*' then 'google' when upper(trim(m)) similar to '(CPH|PLK).*' then 'oneplus' end) maker from d),
f as (select maker, case maker when 'samsung' then case when regexp_matches(m, '^SM-S9[0-9]{2}') or regexp_matches(n, '^SM-S9[0-9]{2}') then 'Galaxy S' when regexp_matches(m, '^SM-F9[0-9]{2}') or regexp_matches(n, '^SM-F9[0-9]{2}') then 'Galaxy Z' when regexp_matches(m, '^SM-A[0-9]{2}') or regexp_matches(n, '^SM-A[0-9]{2}') then 'Galaxy A' when regexp_matches(m, '^SM-M[0-9]{2}') or regexp_matches(n, '^SM-M[0-9]{2}') then 'Galaxy M' end
  when 'google' then case when regexp_matches(m, '(?i)pixel\s?\d+\s?pro') or regexp_matches(n, '(?i)pixel\s?\d+\s?pro') or regexp_matches(m, '(?i)pixel\s?\d+a') or regexp_matches(n, '(?i)pixel\s?\d+a') then 'Pixel' end
  when 'oneplus' then case when regexp_matches(m, '(?i)oneplus\s?\d+') or regexp_matches(n, '(?i)oneplus\s?\d+') then 'OnePlus' when regexp_matches(m, '(?i)oneplus\s?nord') or regexp_matches(n, '(?i)oneplus\s?nord') then 'Nord' end end family from k)
select maker, family, count(*) n from f group by 1, 2"""
)
def q53_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers and families that the rules tell of all sightings."""
    d = table(spark, sf_dir, "discovery_results", "candidate_identifier", "manufacturer", "candidate_marketing_name").where("candidate_identifier is not null")
    return enriched(d, "candidate_identifier", "manufacturer", "candidate_marketing_name").groupBy("known.maker", "known.family").agg(F.count("*").alias("n"))


@PAGES.add(
    """with g as (select 'snapshots' t, fetched_at as ts from snapshots union all select 'collector_run_metrics', started_at from collector_run_metrics union all select 'webhook_deliveries', created_at from webhook_deliveries union all select 'discovery_results', discovered_at from discovery_results)
select t as table_name, count(*) n_rows, cast(date_diff('day', min(ts), max(ts)) as bigint) day_span, round(count(*) / greatest(date_diff('day', min(ts), max(ts)), 1)::double, 6) rows_per_day from g group by t"""
)
def q54_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fast the tables grow."""
    times = {"snapshots": "fetched_at", "collector_run_metrics": "started_at", "webhook_deliveries": "created_at", "discovery_results": "discovered_at"}
    one = lambda t, c: table(spark, sf_dir, t, c).agg(F.count("*").alias("n_rows"), F.datediff(F.max(c), F.min(c)).cast("long").alias("day_span")).select(F.lit(t).alias("table_name"), "n_rows", "day_span")
    parts = [one(t, c) for t, c in times.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.withColumn("rows_per_day", F.round(F.col("n_rows") / F.greatest(F.col("day_span"), F.lit(1)), 6))


@PAGES.add(
    """select manufacturer, codename, marketing_name from (select manufacturer, family_name, arg_min(codename, (first_seen, id)) filter (codename is not null) codename, arg_min(marketing_name, (first_seen, id)) filter (marketing_name is not null) marketing_name from devices where family_name is not null group by 1, 2)"""
)
def q55_fill_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each family the first codename and marketing name that became known."""
    d = table(spark, sf_dir, "devices", "id", "manufacturer", "family_name", "first_seen", "codename", "marketing_name").where("family_name is not null")
    return filled_once(d, ["manufacturer", "family_name"], ["first_seen", "id"], ["codename", "marketing_name"]).drop("family_name")
