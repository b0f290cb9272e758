"""Queries on devices, aliases, evidence and the ledger, each with the same in SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.functions.text import stripped
from sightline.operators import confidence as C
from sightline.operators import entities as E
from sightline.operators.joins import asof_join, first_answer, membership
from sightline.operators.run_metrics import rounded
from sightline.queries.registry import Registry
from sightline.sources import views as V
from sightline.sources.tables import table

RELATIONAL = Registry()
NOW = datetime(2001, 8, 2)
NOW_SQL = "timestamp '2001-08-02'"
AGE_SQL = f"date_diff('microsecond', first_seen, {NOW_SQL}) / 86400000000.0"
DECAY_SQL = f"""case when source_type = 'official' then weight else greatest(cast(round_even(weight * (case when {AGE_SQL} >= 365 then 0.30 when {AGE_SQL} >= 180 then 0.50
  when {AGE_SQL} >= 90 then 0.75 when {AGE_SQL} >= 30 then 0.90 else 1.0 end)::double, 0) as bigint), 0) end"""


@RELATIONAL.add(f"with {V.EVIDENCE_SQL} select device_id, cast(sum(weight) as bigint) base, cast(sum({DECAY_SQL}) as bigint) confidence, count(*) pieces from evidence group by device_id")
def q01_decayed_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each device's evidence weighed, and weighs now."""
    return C.decayed_confidence(V.evidence(spark, sf_dir), NOW)


@RELATIONAL.add(f"with {V.EVIDENCE_SQL}, d as (select device_id, cast(sum({DECAY_SQL}) as bigint) confidence from evidence group by device_id) select * from d order by confidence desc, device_id limit 30")
def q03_top_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 devices of most confidence."""
    return C.decayed_confidence(V.evidence(spark, sf_dir), NOW).select("device_id", "confidence").orderBy(F.desc("confidence"), "device_id").limit(30)


@RELATIONAL.add(
    "select model_number, marketing_name, confidence from devices where (model_number ilike '%pro%' or marketing_name ilike '%pro%' or family_name ilike '%pro%' or codename ilike '%pro%') and confidence >= 20 and active order by last_seen desc, id limit 100"
)
def q04_device_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with a text in any of their names, in any case, by optional filters; the last seen first."""
    d = table(spark, sf_dir, "devices")
    hit = F.col("model_number").ilike("%pro%")
    for c in ("marketing_name", "family_name", "codename"):
        hit = hit | F.col(c).ilike("%pro%")
    return d.where(hit & (F.col("confidence") >= 20) & F.col("active")).orderBy(F.desc("last_seen"), "id").select("model_number", "marketing_name", "confidence").limit(100)


@RELATIONAL.add(f"with {V.EVIDENCE_SQL} select device_id, string_agg(distinct source, ', ' order by source) sources, count(distinct source_type) kinds from evidence group by device_id")
def q05_source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources that saw each device, by name."""
    return V.evidence(spark, sf_dir).groupBy("device_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.countDistinct("source_type").alias("kinds"))


@RELATIONAL.add(
    """with a as (select device_id, count(*) n_aliases, string_agg(trim(value), '|' order by trim(value), alias_type) aliases from aliases group by device_id),
s as (select candidate_identifier model_number, count(*) sightings, count(distinct source) sources from discovery_results group by 1)
select d.id, d.model_number, d.marketing_name, coalesce(n_aliases, 0) n_aliases, aliases, coalesce(sightings, 0) sightings, coalesce(sources, 0) sources
from devices d left join a on a.device_id = d.id left join s on s.model_number = d.model_number"""
)
def q06_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device with its aliases and sightings; children are aggregated before they are joined."""
    d = table(spark, sf_dir, "devices", "id", "model_number", "marketing_name")
    a = table(spark, sf_dir, "aliases", "device_id", "value", "alias_type").groupBy("device_id").agg(
        F.count("*").alias("n_aliases"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.trim("value").alias("v"), "alias_type"))), lambda x: x["v"]), "|").alias("aliases")
    )
    s = table(spark, sf_dir, "discovery_results", "candidate_identifier", "source").groupBy(F.col("candidate_identifier").alias("model_number")).agg(F.count("*").alias("sightings"), F.countDistinct("source").alias("sources"))
    j = d.join(a, d["id"] == a["device_id"], "left").join(s, "model_number", "left")
    return j.select("id", "model_number", "marketing_name", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"), "aliases", F.coalesce("sightings", F.lit(0)).alias("sightings"), F.coalesce("sources", F.lit(0)).alias("sources"))


@RELATIONAL.add("select manufacturer, family_name, count(*) members, string_agg(model_number, ',' order by model_number) models from devices where family_name is not null group by 1, 2")
def q07_family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models of each family, in order."""
    d = table(spark, sf_dir, "devices", "manufacturer", "family_name", "model_number").where("family_name is not null")
    return d.groupBy("manufacturer", "family_name").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_list("model_number")), ",").alias("models"))


@RELATIONAL.add(
    r"""with f as (select id, manufacturer, model_number, first_seen, replace(replace(upper(trim(model_number)), ' ', ''), '-', '') m from devices),
k as (select *, case when length(m) > 4 then regexp_replace(m, '([0-9])[BUNWEJZ0]$', '\1') else m end family_key from f)
select id, model_number, family_key, row_number() over w > 1 is_variant, first_value(model_number) over w parent from k window w as (partition by manufacturer, family_key order by first_seen, id)"""
)
def q08_family_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model's family by its number without the regional ending, its parent and whether it is a variant."""
    d = table(spark, sf_dir, "devices", "id", "manufacturer", "model_number", "first_seen")
    return E.variants(d, "manufacturer", "model_number", ["first_seen", "id"]).select("id", "model_number", "family_key", "is_variant", "parent")


@RELATIONAL.add("select manufacturer, alias_type, v, device_id from (select manufacturer, alias_type, lower(trim(value)) v, device_id, row_number() over (partition by manufacturer, alias_type, lower(trim(value)) order by first_seen, id) n from aliases where trim(value) <> '') where n = 1")
def q09_alias_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who claimed each alias first."""
    a = table(spark, sf_dir, "aliases").withColumn("v", F.lower(stripped(F.col("value")))).where("v <> ''")
    return E.first_owner(a, ["manufacturer", "alias_type", "v"], "device_id", ["first_seen", "id"]).select("manufacturer", "alias_type", "v", "device_id")


@RELATIONAL.add("select v, count(distinct device_id) owners, string_agg(distinct device_id, ',' order by device_id) claimed_by from (select lower(trim(value)) v, device_id from aliases) group by v having count(distinct device_id) > 1")
def q10_alias_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that several devices claim."""
    return E.conflicts(table(spark, sf_dir, "aliases").select(F.lower(stripped(F.col("value"))).alias("v"), "device_id"), ["v"], "device_id")


@RELATIONAL.add(
    """with q as (select distinct trim(candidate_identifier) asked from discovery_results where trim(candidate_identifier) <> ''),
h as (select q.asked, a.device_id, case when q.asked = trim(a.value) then 0 else 1 end r from q join aliases a on lower(q.asked) = lower(trim(a.value)))
select asked, device_id, case r when 0 then 'exact' else 'folded' end how from (select *, row_number() over (partition by asked order by r, device_id) n from h) where n = 1"""
)
def q11_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device of each sighting's identifier by alias: exact first, else in any case."""
    asked = table(spark, sf_dir, "discovery_results", "candidate_identifier").select(stripped(F.col("candidate_identifier")).alias("asked")).where("asked <> ''").distinct()
    return E.lookup_alias(table(spark, sf_dir, "aliases"), asked)


DEDUP_SQL = "d as (select * from (select *, row_number() over (partition by device_id, evidence_id, rule order by line, points) n from ledger) where n = 1)"


@RELATIONAL.add(
    f"with {V.LEDGER_SQL}, {DEDUP_SQL} select device_id, evidence_id, line, rule, points, cast(sum(points) over w as bigint) new_confidence, cast(sum(points) over w - points as bigint) previous_confidence from d window w as (partition by device_id order by evidence_id, line, rule, points rows unbounded preceding)"
)
def q12_ledger_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger, the first entry of each device, evidence and rule, with the confidence before and after each."""
    return C.running(C.deduplicated(V.ledger(spark, sf_dir)))


@RELATIONAL.add(
    f"with {V.LEDGER_SQL}, {DEDUP_SQL}, t as (select device_id, sum(points) s from d group by 1), o as (select device_id, sum(points) s from ledger group by 1) select device_id, cast(t.s as bigint) ledger_total, cast(o.s as bigint) stored, cast(t.s - o.s as bigint) drift from t join o using (device_id) where t.s <> o.s order by abs(t.s - o.s) desc, device_id limit 20"
)
def q13_ledger_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The devices whose stored confidence (here with repeated entries) is furthest from their ledger."""
    ledger = V.ledger(spark, sf_dir)
    return C.drift(C.deduplicated(ledger), ledger.groupBy("device_id").agg(F.sum("points").alias("stored"))).orderBy(F.desc(F.abs("drift")), "device_id").limit(20)


@RELATIONAL.add(f"with {V.LEDGER_SQL}, {DEDUP_SQL}, r as (select * from d union all select device_id, evidence_id, line, 'invalidate:' || rule, -abs(points), n from d where rule = 'R') select device_id, count(*) entries, cast(sum(points) as bigint) confidence from r group by 1")
def q14_ledger_with_reversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence after a rule's entries were invalidated by entries of their own."""
    kept = C.deduplicated(V.ledger(spark, sf_dir))
    return C.with_reversals(kept, F.col("rule") == "R").groupBy("device_id").agg(F.count("*").alias("entries"), F.sum("points").alias("confidence"))


@RELATIONAL.add(
    f"with {V.EVIDENCE_SQL} select device_id, string_agg(source_type || ':' || evidence_id, ' > ' order by first_seen, evidence_id) last_events from (select *, row_number() over (partition by device_id order by first_seen desc, evidence_id desc) n from evidence) where n <= 6 group by device_id"
)
def q15_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six events of each device, in order."""
    w = Window.partitionBy("device_id").orderBy(F.desc("first_seen"), F.desc("evidence_id"))
    e = V.evidence(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n <= 6")
    line = F.concat_ws(":", "source_type", "evidence_id")
    return e.groupBy("device_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_seen", "evidence_id", line.alias("line")))), lambda x: x["line"]), " > ").alias("last_events"))


@RELATIONAL.add("select manufacturer, candidate_identifier, count(*) n from discovery_results where candidate_identifier is not null group by 1, 2 having count(*) > 1")
def q16_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers reported more than once."""
    d = table(spark, sf_dir, "discovery_results", "manufacturer", "candidate_identifier").where("candidate_identifier is not null")
    return d.groupBy("manufacturer", "candidate_identifier").agg(F.count("*").alias("n")).where("n > 1")


@RELATIONAL.add(
    f"with {V.EVIDENCE_SQL}, f as (select device_id, min(first_seen) filter (source_type = 'certification') c, min(first_seen) filter (source_type = 'official') o from evidence group by 1) select count(*) devices, round(avg(date_diff('day', c, o)), 6) avg_days, cast(min(date_diff('day', c, o)) as bigint) least_days, cast(max(date_diff('day', c, o)) as bigint) most_days from f where c is not null and o is not null"
)
def q17_lead_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the first certification of a device to its first official word."""
    at = lambda kind: F.min(F.when(F.col("source_type") == kind, F.col("first_seen")))
    f = V.evidence(spark, sf_dir).groupBy("device_id").agg(at("certification").alias("c"), at("official").alias("o")).where("c is not null and o is not null")
    days = F.datediff("o", "c").cast("long")
    return f.agg(F.count("*").alias("devices"), rounded(F.avg(days)).alias("avg_days"), F.min(days).alias("least_days"), F.max(days).alias("most_days"))


@RELATIONAL.add("select m.manufacturer, count(*) listed, count(*) filter (d.candidate_identifier is null) never_seen from model_validations m left join (select distinct upper(trim(candidate_identifier)) candidate_identifier from discovery_results) d on d.candidate_identifier = upper(m.canonical_model) group by 1")
def q18_never_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed models of which no sighting has the exact code."""
    m = table(spark, sf_dir, "model_validations", "manufacturer", "canonical_model")
    seen = table(spark, sf_dir, "discovery_results", "candidate_identifier").select(F.upper(stripped(F.col("candidate_identifier"))).alias("_seen")).distinct()
    j = m.join(seen, F.upper(m["canonical_model"]) == seen["_seen"], "left")
    return j.groupBy("manufacturer").agg(F.count("*").alias("listed"), F.count_if(F.col("_seen").isNull()).alias("never_seen"))


@RELATIONAL.add(
    """with r as (select candidate_identifier, count(*) n, min(discovered_at) a, max(discovered_at) b from discovery_results where candidate_identifier is not null group by 1)
select candidate_identifier, n, date_diff('day', a, b) as days, arg_min(manufacturer, (discovered_at, result_id)) first_manufacturer from r join discovery_results using (candidate_identifier) where manufacturer is not null group by 1, 2, 3"""
)
def q19_first_seen_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sighting of each identifier, and the first maker that was named for it."""
    d = table(spark, sf_dir, "discovery_results", "candidate_identifier", "discovered_at", "manufacturer", "result_id").where("candidate_identifier is not null")
    first = F.min(F.when(F.col("manufacturer").isNotNull(), F.struct("discovered_at", "result_id", "manufacturer")))["manufacturer"]
    return d.groupBy("candidate_identifier").agg(F.count("*").alias("n"), F.datediff(F.max("discovered_at"), F.min("discovered_at")).cast("long").alias("days"), first.alias("first_manufacturer")).where("first_manufacturer is not null")


@RELATIONAL.add()
def q20_evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sightings are evidence of their own; held against a plain fold in the tests."""
    d = table(spark, sf_dir, "discovery_results", "candidate_identifier", "source", "result_id", "canonical_url", "raw_reference").where("candidate_identifier is not null")
    return E.evidence_dedup(d.select(F.col("candidate_identifier").alias("device_id"), "source", F.col("result_id").alias("ordinal"), F.sha2("raw_reference", 256).alias("content_hash"), F.col("canonical_url").alias("url")))


@RELATIONAL.add(
    f"""with {V.EVIDENCE_SQL}, o as (select *, max(source_type = 'official') over (partition by device_id) word from evidence)
select device_id, cast(sum(case when word then weight else {DECAY_SQL} end) as bigint) confidence, max(word) has_official from o group by device_id"""
)
def q56_official_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence where one official word keeps all of a device's evidence from decaying."""
    e = V.evidence(spark, sf_dir)
    now = C.decayed(F.col("weight"), F.col("source_type"), C.age_days(F.col("first_seen"), NOW))
    g = e.groupBy("device_id").agg(F.sum("weight").alias("_full"), F.sum(now).alias("_now"), F.max(F.col("source_type") == "official").alias("has_official"))
    return g.select("device_id", F.when(F.col("has_official"), F.col("_full")).otherwise(F.col("_now")).alias("confidence"), "has_official")


@RELATIONAL.add("select source, count(*) n_rows, count(*) filter (manufacturer is null) n_unknown, count(*) filter (manufacturer is not null and manufacturer not in ('samsung', 'google', 'oneplus', 'xiaomi')) n_dropped from discovery_results group by 1")
def q57_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of makers that aren't on a list are dropped, and counted; those without a maker pass as unknown."""
    d = table(spark, sf_dir, "discovery_results", "source", "manufacturer")
    off = F.col("manufacturer").isNotNull() & ~F.col("manufacturer").isin("samsung", "google", "oneplus", "xiaomi")
    return d.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("manufacturer").isNull()).alias("n_unknown"), F.count_if(off).alias("n_dropped"))


@RELATIONAL.add(
    """with e as (select l_orderkey k, l_shipdate t, l_linenumber n, l_quantity q from lineitem), o as (select o_orderkey k, o_orderdate t0 from orders)
select e.k, e.n, date_diff('day', t0, t) as days, case when date_diff('day', t0, t) < 30 then 'month' when date_diff('day', t0, t) < 90 then 'quarter' else 'later' end as band from e join o using (k) where date_diff('day', t0, t) between 0 and 60"""
)
def q58_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that followed their order within 60 days, by how soon: an equi join with a range on top."""
    e = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate", "l_linenumber")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    days = F.datediff("l_shipdate", "o_orderdate")
    j = e.join(o, (e["l_orderkey"] == o["o_orderkey"]) & days.between(0, 60))
    band = F.when(days < 30, "month").when(days < 90, "quarter").otherwise("later")
    return j.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), days.cast("long").alias("days"), band.alias("band"))


@RELATIONAL.add(
    """with u as (select o_custkey, o_orderdate, max(o_orderkey) urgent_key from orders where o_orderpriority = '1-URGENT' group by 1, 2)
select o.o_orderkey, u.urgent_key, date_diff('day', u.o_orderdate, o.o_orderdate) as days from orders o asof left join u on o.o_custkey = u.o_custkey and o.o_orderdate > u.o_orderdate"""
)
def q59_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the same customer's latest urgent order before it."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    urgent = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderdate").alias("_at"), F.col("o_orderkey").alias("urgent_key"), F.col("o_orderdate").alias("urgent_at"))
    j = asof_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), urgent, ["o_custkey"], "o_orderdate", "_at", ["urgent_key", "urgent_at"], tie=["urgent_key"], strict=True)
    return j.select("o_orderkey", "urgent_key", F.datediff("o_orderdate", "urgent_at").cast("long").alias("days"))


@RELATIONAL.add(
    """with l as (select distinct upper(canonical_model) m from model_validations), d as (select distinct upper(model_number) m from devices), a as (select distinct upper(trim(value)) m from aliases where alias_type = 'model'), s as (select distinct upper(candidate_identifier) m from discovery_results),
k as (select m from l union select m from d union select m from a union select m from s)
select m, m in (select m from l) listed, m in (select m from d) device, m in (select m from a) alias_of_model, m in (select m from s where m is not null) sighted from k where m is not null"""
)
def q60_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the tables know each model number."""
    t = lambda name, c: table(spark, sf_dir, name, c).select(F.upper(stripped(F.col(c)) if name == "aliases" else F.col(c)).alias("m"))
    named = table(spark, sf_dir, "aliases", "value", "alias_type").where("alias_type = 'model'").select(F.upper(stripped(F.col("value"))).alias("m"))
    return membership({"listed": t("model_validations", "canonical_model"), "device": t("devices", "model_number"), "alias_of_model": named, "sighted": t("discovery_results", "candidate_identifier")}, "m")


@RELATIONAL.add(
    """with n as (select distinct candidate_identifier v from discovery_results where candidate_identifier is not null), f as (select family_name v, min(id) id from devices where family_name is not null group by 1), d as (select marketing_name v, min(id) id from devices where marketing_name is not null group by 1)
select n.v, coalesce(f.id, d.id) id, cast(case when f.id is not null then 0 else 1 end as integer) how from n left join f using (v) left join d using (v) where f.id is not null or d.id is not null"""
)
def q61_first_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device of each identifier by its family's name, else by its marketing name."""
    asked = table(spark, sf_dir, "discovery_results", "candidate_identifier").select(F.col("candidate_identifier").alias("v")).where("v is not null")
    d = table(spark, sf_dir, "devices", "id", "family_name", "marketing_name")
    return first_answer(asked, [d.select(F.col(c).alias("v"), "id") for c in ("family_name", "marketing_name")], "v", "id")


@RELATIONAL.add(
    """select page, last_ok_day from (select source || ' ' || url page, max(fetched_at) filter (status_code between 200 and 299) ok, strftime(max(fetched_at) filter (status_code between 200 and 299), '%Y-%m-%d') last_ok_day, min(fetched_at) f from snapshots group by 1)
order by case when ok is null then 0 else 1 end, ok, f, page limit 60"""
)
def q62_stalest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60 pages to fetch next: those never fetched well first, then the longest ago."""
    s = table(spark, sf_dir, "snapshots", "source", "url", "fetched_at", "status_code")
    ok = F.max(F.when(F.col("status_code").between(200, 299), F.col("fetched_at")))
    g = s.groupBy(F.concat_ws(" ", "source", "url").alias("page")).agg(ok.alias("ok"), F.min("fetched_at").alias("f"))
    top = g.orderBy(F.col("ok").isNotNull(), "ok", "f", "page").limit(60)
    return top.select("page", F.date_format("ok", "yyyy-MM-dd").alias("last_ok_day"))
