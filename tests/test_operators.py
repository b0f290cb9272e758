from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sightline.functions.html import read as read_page
from sightline.functions.text import canonical_json, folded
from sightline.functions.url import asset_url, file_name, host, normal_url
from sightline.operators import confidence as C
from sightline.operators import entities as E
from sightline.operators import identifiers as I
from sightline.operators import page_changes as P
from sightline.operators import run_metrics as M
from sightline.operators import upsert as U
from sightline.operators.joins import asof_join, first_answer, membership
from sightline.operators.enrichment import enriched, filled_once, inferred_maker
from sightline.sources import landed as L
from sightline.sources import sinks as S

T0 = datetime(2020, 1, 1)


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("HTTPS://H.Example/Path/?utm_a=1&b=2#f", "https://h.example/Path?b=2"), ("https://h.example/", "https://h.example"), ("https://h.example", "https://h.example"), ("/p/?utm_x=1", "/p"), ("", ""), (None, None), ("https://h.example/a?b=1&&c", "https://h.example/a?b=1&c")],
)
def test_normal_url(spark, url, want):
    assert one(spark, normal_url(F.col("u").cast("string")), u=url) == want


def test_url_parts(spark):
    u = "https://H.Example:8443/a/b.PDF?x=&y=1&FBCLID=2&sid=3#z"
    assert one(spark, asset_url(F.col("u")), u=u) == "https://H.Example:8443/a/b.PDF?y=1" and one(spark, file_name(F.col("u")), u=u) == "b.PDF" and one(spark, host(F.col("u")), u=u) == "h.example"
    assert one(spark, file_name(F.col("u")), u="https://h.example/") is None


def test_text(spark):
    assert one(spark, folded(F.col("t")), t="  Ab C\t\n") == "ab c"
    a, b = '{"b":1.0,"a":[1, 2]}', '{ "a" : [1,2], "b" : 1 }'
    assert one(spark, canonical_json(F.col("t")), t=a) == one(spark, canonical_json(F.col("t")), t=b)
    assert one(spark, canonical_json(F.col("t")), t=" not json ") == "not json" and one(spark, canonical_json(F.col("t").cast("string")), t=None) is None


def test_decay_steps_and_rounding(spark):
    now = T0 + timedelta(days=1000)
    cases = [(20, 0, 20), (20, 29, 20), (20, 30, 18), (20, 100, 15), (20, 200, 10), (25, 30, 22), (35, 90, 26), (10, 400, 3), (0, 5, 0), (-3, 5, 0)]
    for weight, age, want in cases:
        got = one(spark, C.decayed(F.col("w"), F.lit("ota"), C.age_days(F.col("t"), now)), w=weight, t=now - timedelta(days=age))
        assert got == want, (weight, age, got)
    assert one(spark, C.decayed(F.lit(100), F.lit("official"), F.lit(4000.0))) == 100
    assert one(spark, C.source_weight(F.col("s")), s="ota") == 20 and one(spark, C.source_weight(F.col("s")), s="?") == 10 and one(spark, C.source_weight(F.lit("ota"), F.lit(7))) == 7


def test_ledger(spark):
    rows = [(1, 10, 1, "A", 5), (1, 10, 2, "A", 9), (1, None, 3, "A", 2), (1, None, 4, "A", 2), (2, 11, 1, "B", 4)]
    led = spark.createDataFrame(rows, "device_id long, evidence_id long, line int, rule string, points long")
    kept = C.deduplicated(led)
    assert sorted((r["device_id"], r["line"]) for r in kept.collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    assert {(r["line"], r["previous_confidence"], r["new_confidence"]) for r in C.running(kept).where("device_id = 1").collect()} == {(3, 0, 2), (4, 2, 4), (1, 4, 9)}
    assert C.with_reversals(kept, F.col("rule") == "B").where("device_id = 2").agg(F.sum("points")).first()[0] == 0
    stored = spark.createDataFrame([(1, 9), (3, 4)], "device_id long, stored long")
    assert {(r["device_id"], r["drift"]) for r in C.drift(kept, stored).collect()} == {(2, 4), (3, -4)}


def test_family_keys(spark):
    for model, want in (("SM-S957B", "SMS957"), ("sm-s957 u", "SMS957"), ("Pixel 9 Pro", "PIXEL9PRO"), ("PIXEL 10", "PIXEL1"), ("AB1B", "AB1B"), (None, None)):
        assert one(spark, E.family_key(F.col("m").cast("string")), m=model) == want


def fold(rows):
    kept, out = {}, {}
    for d, s, n, h, u in sorted(rows, key=lambda r: r[2]):
        mine = kept.setdefault((d, s), [])
        seen = any((h is not None and kh == h) or (u is not None and ku == u and (h is None or kh is None or kh == h)) for kh, ku in mine)
        out[n] = not seen
        if not seen:
            mine.append((h, u))
    return out


def test_evidence_dedup_against_fold(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(6)}", rng.choice("st"), i, rng.choice([None, "h1", "h2", "h3"]), rng.choice([None, "u1", "u2"])) for i in range(300)]
    rows += [("all", "s", 1000 + i, f"h{i % 3}", "u") for i in range(9)] + [("none", "s", 2000 + i, None, ["u", None][i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "device_id string, source string, ordinal long, content_hash string, url string")
    got = {r["ordinal"]: r["new_evidence"] for r in E.evidence_dedup(df).collect()}
    assert got == fold(rows)
    assert E.evidence_dedup(df.limit(0)).count() == 0


GRAMMAR_CASES = (
    [("google", "Pixel 10 Pro XL", "VALID"), ("google", "Pixel 21", "INVALID"), ("google", "pixel", "INVALID"), ("google", "Galaxy S25", "INVALID"), ("oneplus", "CPH2653", "VALID"), ("oneplus", "CPH26531", "INVALID"), ("nothing", "Phone (3a) Pro", "VALID"), ("xiaomi", "Redmi Note 14 Pro", "VALID"), ("honor", "honor magic 7 pro", "VALID"), ("realme", "realme GT 7 Pro", "VALID"), ("asus", "Zenfone 12 Ultra", "VALID"), ("motorola", "moto g power 5G 2025", "VALID"), ("motorola", "Moto Z", "AMBIGUOUS"), ("oppo", "Find X8 Ultra", "VALID"), ("oppo", "reno", "INVALID"), ("vivo", "X200 Pro", "VALID"), ("vivo", "iQOO 13", "INVALID"), ("google", "Accept all cookies", "INVALID"), ("google", None, "INVALID"), ("nobody", "X 1", "INVALID"), (None, "X 1", "INVALID")]
)


def test_grammars(spark):
    df = spark.createDataFrame([(m, t) for m, t, _ in GRAMMAR_CASES], "m string, c string")
    assert [(r["m"], r["c"], r["validation"]["outcome"]) for r in I.validated_by_maker(df, "c", "m").collect()] == GRAMMAR_CASES


def test_rejections(spark):
    for text, want in (("", "empty_field"), ("x" * 41, "too_long"), ("Galaxy Watch 7", "watch_not_phone"), ("the best phone for you", "contains_sentence"), ("SM-S928B", None)):
        assert one(spark, I.rejected(F.col("c")), c=text) == want


def test_samsung(spark):
    m = one(spark, I.samsung_model(F.col("c")), c="sm-s957b/ds")
    assert (m["canonical"], m["category"], m["region"], m["family_key"]) == ("SM-S957B", "smartphone", "global_or_india", "SMS957")
    assert one(spark, I.samsung_model(F.col("c")), c="SM-S928U1")["region"] == "usa_unlocked" and one(spark, I.samsung_model(F.col("c")), c="SM-R960")["reason"] == "excluded_category:smartwatch"
    assert one(spark, I.find_models(F.col("c")), c="sm-a156b, SM-A156B and SM-F956U") == ["SM-A156B", "SM-F956U"]


def test_reasons_and_families(spark):
    cases = [
        ("xiaomi", "M2007J3SY00000000", "INVALID", "invalid_length", None), ("xiaomi", "M2007J3SY", "VALID", None, None), ("xiaomi", "M2", "INVALID", "invalid_length", None), ("xiaomi", "M2007-3SYX", "AMBIGUOUS", "unrecognized_xiaomi_format", None), ("xiaomi", "poco f6", "AMBIGUOUS", "unrecognized_xiaomi_format", None), ("xiaomi", "POCO F6 Pro", "VALID", None, "POCO"),
        ("vivo", "iQOO 12", "INVALID", "iqoo_not_vivo", None), ("vivo", "x200 pro", "VALID", None, "X-series"), ("vivo", "V", "INVALID", "family_name_without_model", None), ("vivo", "Xplay", "AMBIGUOUS", "unrecognized_vivo_format", None),
        ("asus", "ROG Strix G16", "INVALID", "pc_hardware", None), ("asus", "ROG Phone 8", "VALID", None, "Rog Phone"), ("asus", "ROG", "INVALID", "family_name_without_model", None), ("asus", "ROG Ally", "INVALID", "invalid_prefix", None), ("asus", "Zenfone 12 Ultra", "VALID", None, "Zenfone"),
        ("oppo", "A5 Pro", "VALID", None, "A"), ("oppo", "Find X8", "VALID", None, "Find X"), ("oppo", "find n5 flip 5g", "VALID", None, "Find N"), ("oppo", "Reno13 Pro", "VALID", None, "Reno"), ("oppo", "Find X", "INVALID", "family_name_without_model", None),
        ("honor", "Honor 600 Pro", "VALID", None, "Numbered"), ("honor", "Honor Magic", "AMBIGUOUS", "unrecognized_honor_format", None), ("realme", "realme narzo 80x 5G", "VALID", None, "named-series"), ("motorola", "moto g power 5G 2025", "VALID", None, "Moto G"), ("google", "Pixel 0", "INVALID", "invalid_generation", None),
        ("google", "Pixel Nova", "AMBIGUOUS", "unrecognized_pixel_format", None), ("nothing", "CMF Phone 2", "VALID", None, "CMF Phone"), ("oneplus", "PLK12", "INVALID", "invalid_length", None), ("oneplus", " ", "INVALID", "empty_field", None),
    ]
    df = spark.createDataFrame([(m, t) for m, t, *_ in cases], "m string, c string")
    got = [(r["m"], r["c"], r["validation"]["outcome"], r["validation"]["reason"], r["validation"]["family"]) for r in I.validated_by_maker(df, "c", "m").collect()]
    assert got == cases
    rows = {r["c"]: r for r in I.validated_by_maker(df, "c", "m").collect()}
    assert rows["CMF Phone 2"]["validation"]["brand"] == "cmf" and not rows["CMF Phone 2"]["bridged"] and rows["x200 pro"]["validation"]["normalized"] == "X200 PRO" and rows["POCO F6 Pro"]["bridged"]


SLUG_CASES = (
    [
        ("xiaomi", None, "redmi-note-13-pro-plus", "Redmi Note 13 Pro+"), ("xiaomi", None, "poco-f6", "POCO F6"), ("xiaomi", None, "poco-x7-pro", "POCO X7 Pro"), ("xiaomi", None, "Xiaomi-14t-pro", "Xiaomi 14t Pro"), ("xiaomi", None, "xiaomi-15-ultra", "Xiaomi 15 Ultra"), ("xiaomi", None, "redmi-note", None), ("xiaomi", None, "redmi", None), ("xiaomi", None, "smart-band-9", None),
        ("oppo", "a", "a5-pro-5g", "A5 Pro 5G"), ("oppo", "reno", "reno", None), ("oppo", "find-x", "find-x8-pro", "Find X8 Pro"), ("oppo", "find-n", "find-n5", "Find N5"), ("oppo", "reno", "reno13-pro", "Reno13 Pro"), ("oppo", "pad", "pad-3", None),
        ("realme", None, "realme-gt7-pro-5g", "realme GT 7 Pro 5G"), ("realme", None, "realme-12-pro-plus", "realme 12 Pro Plus"), ("realme", None, "realme-", None), ("realme", None, "buds-air", None), ("honor", None, "honor-magic-v-6", "Honor Magic V6"), ("honor", None, "honor-600-pro", "Honor 600 Pro"), ("honor", None, "magic-6", None),
        ("motorola", "razr", "razr-plus-gen-2", "Razr Plus Gen 2"), ("motorola", "moto-g", "moto-g-power-2026", "Moto G Power 2026"), ("motorola", "moto-g", "g-stylus-5g-gen-4", "Moto G G Stylus 5G Gen 4"), ("motorola", "razr", "razr", "Razr"), ("motorola", "tablet", "tab-1", None),
        ("google", None, "pixel_9_pro_xl", "Pixel 9 Pro XL"), ("google", None, "pixel_9a", "Pixel 9a"), ("google", None, "pixel_9_pro_fold", "Pixel 9 Pro Fold"), ("google", None, "nest_hub", None), ("oneplus", None, "oneplus-13r", "OnePlus 13R"), ("oneplus", None, "n30-5g", "OnePlus Nord 30-5G"), ("oneplus", None, "open", "OnePlus Open"), ("oneplus", None, "support", None), ("oneplus", None, "13-case", None), ("oneplus", None, "12-pro", "OnePlus 12 Pro"),
        ("nothing", None, "phone-3a-pro", "Phone (3a) Pro"), ("nothing", None, "cmf-phone-2", "CMF Phone 2"), ("nothing", None, "cmf-phone-pro", None), ("nothing", None, "ear-a", None), ("xiaomi", None, None, None),
    ]
)


@pytest.mark.parametrize("maker", sorted({m for m, *_ in SLUG_CASES}))
def test_slug_names(spark, maker):
    mine = [(s, f, n) for m, f, s, n in SLUG_CASES if m == maker]
    df = spark.createDataFrame([(s, f) for s, f, _ in mine], "s string, f string")
    got = df.select("s", "f", I.slug_name(F.col("s"), maker, F.col("f") if maker in ("oppo", "motorola") else None).alias("n")).collect()
    assert [tuple(r) for r in got] == mine


A = '<html><head><title>Alpha</title></head><body><script>x</script><h1>SM-A156B</h1><a href="/m/guide.pdf?utm_source=1">Manual</a><img src="/hero/phone.png?x=1" alt="phone"><p>one</p></body></html>'
B = A.replace("<p>one</p>", "<p>one</p><p>two</p><p>three</p><p>four</p>")
PAGES = [
    ("1", "s", "u", 0, 200, A), ("2", "s", "u", 1, 200, A.replace("<script>x", "<script>y")), ("3", "s", "u", 2, 500, None), ("4", "s", "u", 3, 200, B), ("5", "s", "u", 4, 200, B.replace("</body>", '<a href="/fw.zip">firmware</a></body>')),
    ("6", "s", "u", 5, 200, B.replace("Alpha", "Beta")), ("7", "s", "v", 0, 200, None), ("8", "s", "w", 0, 200, ""),
]


def test_page_changes(spark):
    df = spark.createDataFrame([(i, s, u, T0 + timedelta(days=d), c, h) for i, s, u, d, c, h in PAGES], "id string, source string, url string, fetched_at timestamp, status_code int, content string")
    got = {r["id"]: r["change"] for r in P.page_history(P.fingerprints(df)).collect()}
    assert got["1"]["classes"] == ["NEW_PAGE"] and got["1"]["score"] == 10 + 18 + 10
    assert got["2"]["classes"] == ["FORMAT_ONLY"] and not got["2"]["meaningful"] and got["2"]["score"] == 0
    assert got["3"]["classes"] == ["FETCH_ERROR"]
    assert got["4"]["classes"] == ["TEXT_CHANGED"] and got["4"]["meaningful"]
    assert "DOWNLOAD_ADDED" in got["5"]["classes"] and got["5"]["score"] == 20
    assert got["6"]["classes"][0] == "TITLE_CHANGED" and "DOWNLOAD_REMOVED" in got["6"]["classes"]


def test_page_parts():
    p = read_page(A)
    assert p["title"] == "Alpha" and p["text"] == "SM-A156B\nManual\none" and p["links"] == [{"href": "/m/guide.pdf?utm_source=1", "text": "Manual"}] and p["images"][0]["src"] == "/hero/phone.png?x=1"
    for odd in (None, "", "<", "</b></i>", "<a", "<p>" * 5000, "x" * 100_000):
        read_page(odd)


def test_removals(spark):
    codes = [200, 404, 404, 500, 410, 404, 200, 404, 200]
    df = spark.createDataFrame([(str(i), "s", "u", T0 + timedelta(days=i), c) for i, c in enumerate(codes)], "id string, source string, url string, fetched_at timestamp, status_code int")
    got = {r["id"]: (r["streak"], r["page_state"]) for r in P.removals(df).collect()}
    assert got == {"0": (0, None), "1": (1, None), "2": (2, None), "4": (3, "PAGE_REMOVED"), "5": (4, None), "6": (0, "PAGE_RESTORED"), "7": (1, None), "8": (0, None)}


def test_assets(spark):
    assert one(spark, P.download_class(F.lit("Get it"), F.lit("/from/x.bin"))) == "firmware" and one(spark, P.download_class(F.lit("User guide"), F.lit("/x.pdf"))) == "user_manual" and one(spark, P.download_class(F.lit(None).cast("string"), F.lit("/x.pdf"))) == "generic_document"
    assert one(spark, P.image_class(F.lit("logo"), F.lit("/hero.png"))) == "logo" and one(spark, P.image_class(F.lit(None).cast("string"), F.lit("/a.png"))) == "decorative"


def test_nth_value_and_baseline(spark):
    rows = [("a", f"r{i}", T0 + timedelta(hours=i), (i * 37) % 100, "success", i) for i in range(60)] + [("b", f"q{i}", T0, 5, "failed", 1) for i in range(2)] + [("c", "x", T0, None, None, None)]
    df = spark.createDataFrame(rows, "collector string, run_id string, started_at timestamp, duration_ms int, status string, candidates_found int").withColumn("pages_fetched", F.col("candidates_found")).withColumn("http_failures", F.lit(0))
    got = {r["collector"]: r["p"] for r in M.nth_value(df, ["collector"], "duration_ms", 0.95, "p").collect()}
    assert got == {"a": sorted(r[3] for r in rows[:60])[57], "b": 5}
    base = {r["collector"]: r for r in M.baseline(df).collect()}
    assert set(base) == {"a"} and base["a"]["sample_count"] == 50 and base["a"]["median_candidates"] == 34.5
    roll = {r["run_id"]: r for r in M.rolling_baseline(df, 3).collect()}
    assert len(roll) == 63 and roll["r59"]["median_candidates"] == 34.5 and roll["r2"]["sample_count"] == 3 and roll["r2"]["median_candidates"] == 1


def test_upserts(spark):
    a = spark.createDataFrame([("x", None, 1, 5), ("y", "m", 2, 6)], "k string, name string, n int, at int")
    b = spark.createDataFrame([("x", "new", 3, 4), ("z", "q", 1, 9)], "k string, name string, n int, at int")
    got = {tuple(r) for r in U.upserted(a, b, ["k"], fill=["name"], add=["n"], last=["at"]).collect()}
    assert got == {("x", "new", 4, 5), ("y", "m", 2, 6), ("z", "q", 1, 9)}
    known, listed = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",)], "k string")
    assert {tuple(r) for r in U.synchronised(known, listed, "k").collect()} == {("a", False), ("b", True)}
    assert {tuple(r) for r in U.synchronised(known, listed.limit(0), "k").collect()} == {("a", True), ("b", True)}


def test_replace_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    U.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), path, ["d"])
    for _ in range(2):
        U.replace_partitions(spark.createDataFrame([(9, "b")], "v int, d string"), path, ["d"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (9, "b")]


def test_landed(spark, tmp_path):
    xml = '<urlset xmlns="x"><url><loc> https://h.example/phones/a?x=1&amp;y=2 </loc><lastmod>2020-01-01</lastmod></url><url><loc>https://h.example/tv/b</loc></url><url><loc>broken'
    maps = spark.createDataFrame([("s", xml), ("t", None)], "source string, xml string")
    assert [(r["loc"], r["lastmod"]) for r in L.sitemap_urls(maps, keep="/phones/").collect()] == [("https://h.example/phones/a?x=1&y=2", "2020-01-01")]
    known = spark.createDataFrame([("https://h.example/tv/b/",)], "loc string")
    assert L.novel_urls(L.sitemap_urls(maps), known).count() == 1
    pages = spark.createDataFrame([("p", "Pixel 10 and pixel 10 CPH1234\nComing soon: Pixel 11 series", '<a href="/product/abc_1">x</a> /product/abc_1')], "id string, text string, html string")
    assert [r["slug"] for r in L.hrefs(pages, r"/product/([a-z0-9_]+)").collect()] == ["abc_1"]
    assert [r["teaser"] for r in L.teasers(pages, r"(Pixel \d+) series", ["coming"]).collect()] == ["Pixel 11"]
    assert {(r["manufacturer"], r["model_number"]) for r in L.mentions(pages, {"google": r"(?i)(pixel \d+)", "oneplus": r"(CPH\d{4})"}).collect()} == {("google", "PIXEL 10"), ("google", "PIXEL 11"), ("oneplus", "CPH1234")}
    assert L.certifications(pages.union(pages), {"oneplus": r"(CPH\d{4})"}).count() == 1 and L.empty(spark).count() == 0
    assert one(spark, L.unusable(F.lit("https://consent.h.example/"), F.lit("x"))) == "consent_page" and one(spark, L.unusable(F.lit("https://h.example/"), F.lit("hello"))) is None
    log = spark.createDataFrame([("s", 200, 10, None), ("s", 404, 0, None), ("s", None, None, "timeout")], "source string, status_code int, bytes long, error string")
    m = L.fetch_metrics(log).first()
    assert (m["http_requests"], m["http_failures"], m["timeouts"], m["bytes_downloaded"], m["status_counts"]) == (3, 2, 1, 10, {"200": 1, "404": 1})
    (tmp_path / "d.json").write_text('{"a": {"x": 1}, "b": {"y": "2"}}')
    assert sorted(map(tuple, L.dimension(spark, str(tmp_path / "d.json"), "k").collect()), key=str) == [("a", "1", None), ("b", None, "2")]
    assert L.overlaid({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    for fmt in ("parquet", "orc", "json", "csv"):
        pages.select("id", "html").write.format(fmt).option("header", True).save(str(tmp_path / fmt))
        assert L.read(spark, str(tmp_path / fmt), fmt, "id string, html string").first()["id"] == "p"
    with pytest.raises(ValueError):
        L.read(spark, "x", "exe")


def test_sinks(spark):
    assert one(spark, S.truncated(F.col("t"), 5), t="abcdefgh") == "abcd…"
    attempts = spark.createDataFrame([("a", 1, 500, None), ("a", 2, 204, None), ("b", 1, 429, None), ("c", 1, None, "timeout")], "k string, attempt int, status_code int, error string")
    assert {tuple(r) for r in S.delivery_outcome(attempts, "k").collect()} == {("a", 2, True, "delivered"), ("b", 1, False, "rate_limited"), ("c", 1, False, "timeout")}
    text = S.markdown(spark.createDataFrame([("x|y", None)], "a string, b int"), "T")
    assert "x\\|y" in text and text.startswith("# T")
    with pytest.raises(ValueError):
        S.markdown(spark.range(10), "T", 5)
    assert S.markdown_lines(spark.createDataFrame([("m", "n", None)], "a string, b string, c string"), "a", {"b": "B", "c": "C"}).first()["markdown"] == "# m\n- B: n"


def test_enrichment(spark):
    df = spark.createDataFrame([("SM-S928U", None, None), ("CPH1", None, "OnePlus 13"), ("GXX", None, "Pixel 9a"), ("zz", "nobody", None), (None, None, None), ("SM-S921B", "samsung", None)], "model string, maker string, name string")
    got = [tuple(r["known"]) for r in enriched(df, "model", "maker", "name").collect()]
    assert got == [("samsung", "Galaxy S", "flagship", "usa", 1, "high"), ("oneplus", "OnePlus", "flagship", None, None, "medium"), ("google", "Pixel", "midrange", None, None, "medium"), ("nobody", None, None, None, None, "low"), (None, None, None, None, None, "low"), ("samsung", "Galaxy S", "flagship", "global_or_india", 1, "high")]
    assert one(spark, inferred_maker(F.col("m")), m="plk110") == "oneplus"
    rows = spark.createDataFrame([("a", 2, "x", None), ("a", 1, None, "q"), ("a", 3, "y", "r")], "k string, n int, c string, d string")
    assert [tuple(r) for r in filled_once(rows, ["k"], ["n"], ["c", "d"]).collect()] == [("a", "x", "q")]


@pytest.mark.parametrize("strict", [False, True])
def test_asof_join_against_brute_force(spark, strict):
    rng = random.Random(2)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([*range(12), None])) for i in range(80)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(0, 12, 2), None]), i) for i in range(30)]
    j = asof_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, rt int, v int"), ["k"], "t", "rt", ["v"], ["v"], strict)
    got = {r["id"]: r["v"] for r in j.collect()}
    for i, k, t in left:
        hits = [(rt, v) for rk, rt, v in right if k is not None and rk == k and rt is not None and t is not None and (rt < t if strict else rt <= t)]
        assert got[i] == (max(hits)[1] if hits else None)
    assert len(got) == 80


def test_membership_and_first_answer(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("y",), ("z",)], "k string")
    assert {tuple(r) for r in membership({"a": a, "b": b}, "k").collect()} == {("x", True, False), ("y", True, True), ("z", False, True)}
    one_, two = spark.createDataFrame([("x", 2), ("x", 1), ("q", None)], "k string, v int"), spark.createDataFrame([("x", 0), ("y", 9)], "k string, v int")
    assert {tuple(r) for r in first_answer(a.unionByName(b), [one_, two], "k", "v").collect()} == {("x", 1, 0), ("y", 9, 1)}
