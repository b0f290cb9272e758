"""Fingerprints of pages, what changed between one and the next, and how much that tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.html import dom_signature, page_parts
from sightline.functions.url import asset_url, file_name

# Hints by which assets are classed, in the order in which they are tried, and what changes weigh.
DOWNLOAD_WORDS = ("download", "firmware", "ota", ".zip", ".pdf", ".doc", "manual", "rom", "guide")
FIRMWARE = ("firmware", "ota", "rom", "software update", "sw update", ".zip", ".tar")
MANUAL = ("manual", "user guide", "userguide", "user_manual", "handbook", "quick start")
REGULATORY = ("regulatory", "compliance", "sar", "fcc", "declaration", "safety")
LOGO, ICON = ("logo", "brand", "wordmark"), ("icon", "sprite", "favicon", "arrow", "chevron", "social")
RENDER = ("product", "device", "phone", "render", "hero", "gallery", "official")
MODELS = (r"(?i)\b(SM-[A-Z0-9]{4,10})\b", r"(?i)\b(CPH\d{4})\b", r"(?i)\b(G[A-Z0-9]{6,12})\b", r"(?i)\b(A0\d{2}|A1\d{2})\b", r"(?i)\b(Pixel\s?(?:[0-9]+|a|Pro|Fold)[a-zA-Z0-9\s]*)\b")
STRONG = ("NEW_PAGE", "DOWNLOAD_ADDED", "DOWNLOAD_REMOVED", "DOWNLOAD_CHANGED", "MODEL_REFERENCE_ADDED", "TITLE_CHANGED", "PAGE_RESTORED")
WEIGHTS = {"NEW_PAGE": 10, "MODEL_REFERENCE_ADDED": 8, "TITLE_CHANGED": 3, "PAGE_RESTORED": 2}
DOWNLOAD_WEIGHTS = {"user_manual": 18, "firmware": 20, "regulatory_document": 15}
DOWNLOAD_WEIGHT, RENDER_WEIGHT = 3, 10
LEAST_LINES = 3


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text contains any of the words, as parts of words too."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def download_class(title: Column, url: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", title, url, file_name(url)))
    return F.when(has_any(blob, FIRMWARE), "firmware").when(has_any(blob, MANUAL), "user_manual").when(has_any(blob, REGULATORY), "regulatory_document").otherwise("generic_document")


def image_class(alt: Column, url: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", alt, url, file_name(url)))
    return F.when(has_any(blob, LOGO), "logo").when(has_any(blob, ICON), "icon").when(has_any(blob, RENDER), "product_render").otherwise("decorative")


def model_references(text: Column) -> Column:
    """Model numbers and names in a text, sorted, each once."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in MODELS]))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.trim(m))))  # F.trim itself would take the index as the characters to trim


def sha(c: Column) -> Column:
    """SHA-256 in hex; null for a null or empty text."""
    return F.when(c != "", F.sha2(c, 256))


def _once(assets: Column, key: str) -> Column:
    """The first of each key."""
    keys = F.transform(assets, lambda a: a[key])
    return F.filter(assets, lambda a, i: F.array_position(keys, a[key]) == i + 1)


def fingerprints(pages: DataFrame, html: str = "content") -> DataFrame:
    """Adds `print`: title, text, hashes of content, text, structure, title, downloads and images, the assets themselves, and model references.

    The page is read once, in batches; all else are expressions on what was read. A null page has nulls and empty arrays.
    """
    p = F.col("_parts")
    links = F.filter(p["links"], lambda a: (a["href"] != "") & ~a["href"].startswith("#") & ~a["href"].startswith("javascript:") & has_any(F.lower(F.concat_ws("\n", a["href"], a["text"])), DOWNLOAD_WORDS))
    downloads = F.transform(links, lambda a: F.struct(asset_url(a["href"]).alias("url"), F.coalesce(F.nullif(a["text"], F.lit("")), file_name(a["href"])).alias("title"), download_class(a["text"], a["href"]).alias("category")))
    images = F.transform(p["images"], lambda a: F.struct(asset_url(F.substring_index(a["src"], "?", 1)).alias("url"), a["alt"].alias("title"), image_class(a["alt"], a["src"]).alias("category")))
    urls = lambda c: F.array_join(F.array_sort(F.transform(F.col(c), lambda a: a["url"])), "\n")
    df = pages.withColumn("_parts", page_parts(F.col(html))).withColumn("_downloads", _once(downloads, "url")).withColumn("_images", _once(images, "url"))
    return df.withColumn(
        "print",
        F.struct(
            p["title"].alias("title"), p["text"].alias("text"), sha(F.regexp_replace(F.col(html), r"\s+", " ")).alias("content_hash"), sha(F.regexp_replace(p["text"], r"\s+", " ")).alias("text_hash"), sha(dom_signature(F.col(html))).alias("dom_hash"),
            sha(p["title"]).alias("title_hash"), sha(urls("_downloads")).alias("download_hash"), sha(urls("_images")).alias("image_hash"), F.col("_downloads").alias("downloads"), F.col("_images").alias("images"),
            model_references(F.concat_ws("\n", p["title"], p["text"])).alias("models"),
        ),
    ).drop("_parts", "_downloads", "_images")


def lines_added(new: Column, old: Column) -> Column:
    """The number of different lines that one text has and the other hasn't."""
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x != "")
    return F.size(F.array_except(lines(new), lines(old)))


def _of(assets: Column, field: str) -> Column:
    return F.transform(assets, lambda a: a[field])


def compared(old: Column, new: Column, status: Column) -> Column:
    """classes, meaningful and score of the change from one fingerprint to the next; a failed fetch is FETCH_ERROR, a page without a past NEW_PAGE."""
    d0, d1, i0, i1 = old["downloads"], new["downloads"], old["images"], new["images"]
    fresh_d = F.filter(d1, lambda a: ~F.array_contains(_of(d0, "url"), a["url"]))
    fresh_i = F.filter(i1, lambda a: ~F.array_contains(_of(i0, "url"), a["url"]))
    renamed = F.exists(d1, lambda a: F.exists(d0, lambda b: (a["url"] == b["url"]) & (F.coalesce(a["title"], F.lit("")) != F.coalesce(b["title"], F.lit("")))))
    text, dom = F.coalesce(old["text_hash"] != new["text_hash"], F.lit(False)), F.coalesce(old["dom_hash"] != new["dom_hash"], F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(F.coalesce(old["title"], F.lit("")) != F.coalesce(new["title"], F.lit("")), "TITLE_CHANGED"),
            F.when(F.size(F.array_except(new["models"], old["models"])) > 0, "MODEL_REFERENCE_ADDED"), F.when(F.size(F.array_except(old["models"], new["models"])) > 0, "MODEL_REFERENCE_REMOVED"),
            F.when(F.size(fresh_d) > 0, "DOWNLOAD_ADDED"), F.when(F.size(F.array_except(_of(d0, "url"), _of(d1, "url"))) > 0, "DOWNLOAD_REMOVED"), F.when(renamed, "DOWNLOAD_CHANGED"),
            F.when(F.size(fresh_i) > 0, "IMAGE_ADDED"), F.when(F.size(F.array_except(_of(i0, "url"), _of(i1, "url"))) > 0, "IMAGE_REMOVED"),
            F.when(text, "TEXT_CHANGED"), F.when(dom & ~text, "DOM_CHANGED"),
        )
    )
    silent = F.when(~old["content_hash"].eqNullSafe(new["content_hash"]), F.array(F.lit("FORMAT_ONLY"))).otherwise(F.array(F.lit("NO_CHANGE")))
    failed = F.coalesce((status >= 500) | status.isin(404, 410), F.lit(False))
    first = old.isNull()
    classes = F.when(failed, F.array(F.lit("FETCH_ERROR"))).when(first, F.array(F.lit("NEW_PAGE"))).when(F.size(found) > 0, found).otherwise(silent)
    gained_d, gained_i = F.when(first, d1).otherwise(fresh_d), F.when(first, i1).otherwise(fresh_i)
    renders = F.size(F.filter(gained_i, lambda a: a["category"] == "product_render"))
    delta = lines_added(new["text"], old["text"]) + lines_added(old["text"], new["text"])
    meaningful = ~failed & (F.arrays_overlap(classes, F.array(*map(F.lit, STRONG))) | (F.array_contains(classes, "TEXT_CHANGED") & (delta >= LEAST_LINES)) | (F.array_contains(classes, "IMAGE_ADDED") & (renders > 0)))
    weight = F.lit(0)
    for name, w in WEIGHTS.items():
        weight = weight + F.when(F.array_contains(classes, name), w).otherwise(0)
    by_class = F.create_map(*[F.lit(x) for kv in DOWNLOAD_WEIGHTS.items() for x in kv])
    weight = weight + F.aggregate(gained_d, F.lit(0), lambda s, a: s + F.coalesce(by_class[a["category"]], F.lit(DOWNLOAD_WEIGHT))) + renders * RENDER_WEIGHT
    return F.struct(classes.alias("classes"), meaningful.alias("meaningful"), F.when(failed, 0).otherwise(weight).alias("score"))


def page_history(pages: DataFrame, key: tuple[str, ...] = ("source", "url"), at: str = "fetched_at", tie: str = "id") -> DataFrame:
    """Adds `change` to fingerprinted fetches: against the last successful fetch of the same page before."""
    w = Window.partitionBy(*key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    good = F.coalesce((F.col("status_code") < 400) & F.col("content").isNotNull(), F.lit(False))
    before = F.last(F.when(good, F.col("print")), ignorenulls=True).over(w)
    return pages.withColumn("_before", before).withColumn("change", compared(F.col("_before"), F.col("print"), F.col("status_code"))).drop("_before")


def removals(fetches: DataFrame, key: tuple[str, ...] = ("source", "url"), at: str = "fetched_at", tie: str = "id", misses: int = 3) -> DataFrame:
    """Adds streak and page_state: a page is removed at its third 404 or 410 in a row, restored at the next success; other failures say nothing.

    Gaps and islands: successes number the islands, misses are counted within them, neutral fetches are left out before.
    """
    miss, ok = F.col("status_code").isin(404, 410), F.col("status_code").between(200, 299)
    df = fetches.where(miss | ok)
    w = Window.partitionBy(*key).orderBy(at, tie)
    df = df.withColumn("_island", F.sum(ok.cast("int")).over(w))
    inside = Window.partitionBy(*key, "_island").orderBy(at, tie)
    df = df.withColumn("streak", F.sum(miss.cast("int")).over(inside))
    before = F.lag("streak").over(w)
    state = F.when(F.col("streak") == misses, "PAGE_REMOVED").when(ok & (before >= misses), "PAGE_RESTORED")
    return df.withColumn("page_state", state).drop("_island")
