"""Operators on fetched pages: main body (problem 4) and residue (problem 5)."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm import webpage as W
from sightline.llm.page_residue import evidence
from sightline.plans.materialize import BROADCAST_BYTES, written

#: A line that is likelier outside bodies than this is known to stand around them; Z is how many standard errors its share must be away.
AROUND, Z = 0.5, 1.0
#: A line on this share of a host's pages is the host's boilerplate; Z_RECURRENT is how many standard errors the share must be above.
RECURRENT, Z_RECURRENT = 0.5, 2.58
#: Lines are known if they are on this share of a host's pages, and two at least: so a host has at most 1 / LEAST_SHARE times as many as a page has lines.
LEAST_SHARE = 0.002


def _pages(snapshots: DataFrame, id: str, url: str, title: str, content: str) -> DataFrame:
    """Rows with content: id, what the page's address calls it, host, content, and _key, which equal pages share."""
    rows = snapshots.select(F.col(id).cast("string").alias("_id"), F.col(url).alias("_url"), F.col(title).alias("_title"), F.col(content).alias("_content")).where(r"_id is not null and _content rlike '\\S'")
    host = F.lower(F.regexp_extract("_url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1))
    path = F.regexp_replace("_url", r"[?#].*$", "")
    return rows.select("_id", F.coalesce(path, "_title").alias("_name"), F.coalesce(host, F.lit("")).alias("_host"), "_content").withColumn("_key", F.md5(F.concat_ws("\n", "_name", "_content")))


def _distinct(pages: DataFrame) -> DataFrame:
    """Each page as it was fetched, once, however many sweeps found it unchanged: copies collapse before the shuffle, and are parsed once."""
    return pages.groupBy("_key").agg(F.first("_name").alias("_name"), F.first("_host").alias("_host"), F.first("_content").alias("_content"))


def _own(name: str | None) -> str:
    return W.slug(name) if name and "/" in name else W.slug(None, name)


READ = "_key string, _host string, _page binary, _markup boolean, _within array<bigint>, _about array<bigint>, _all array<bigint>"


def _read(parts: Iterator[pd.DataFrame], judge: bool) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for key, host, content, name in zip(p["_key"], p["_host"], p["_content"], p["_name"], strict=True):
            page = W.read(content, _own(name), evidence if judge else None)
            within, about = W.told(page)
            rows.append((key, host, pickle.dumps(tuple(vars(page).values())), page.markup, within, about, list({u: None for us in page.units for u in us})))
        yield pd.DataFrame(rows, columns=["_key", "_host", "_page", "_markup", "_within", "_about", "_all"])


def _bound(share: Column, n: Column, z: float, sign: int) -> Column:
    """The lower (sign -1) or upper (1) bound of a share that was seen in n cases, by Wilson's formula."""
    return (share + z * z / (2 * n) + sign * z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _side(out: str, inside: str) -> Column:
    """True if lines seen so often outside and inside of bodies stand around them, false if they are of them, null if it can't be told."""
    n = F.nullif(F.col(out) + F.col(inside), F.lit(0))
    share = F.try_divide(F.col(out), n)
    return F.when(_bound(share, n, Z, -1) > AROUND, True).when(_bound(share, n, Z, 1) < AROUND, False)


def learned(read: DataFrame) -> DataFrame:
    """_host, _pages, _known, _body, _usual: of each host the number of its distinct pages, and hashes of its recurring lines: those known to stand around
    bodies, those of bodies, and those on RECURRENT of its pages.

    Where a line stands is told by the elements it lies in on pages with markup: on the host, or where these leave it open, on all hosts; if no markup
    tells, by the ratios' core on the host's pages without. A line's pages are counted by host first, then by line, so a hot host or line is only added up.
    """
    hosts = read.groupBy("_host").agg(F.count("*").alias("_pages"))
    seen = read.select("_host", "_markup", F.explode(F.concat(F.transform("_within", lambda u: F.struct(u.alias("u"), F.lit(True).alias("in"))), F.transform("_about", lambda u: F.struct(u.alias("u"), F.lit(False).alias("in"))))).alias("l"))
    counts = [F.count_if(F.col("_markup") & F.col("l.in")).alias("si"), F.count_if(F.col("_markup") & ~F.col("l.in")).alias("so"), F.count_if(~F.col("_markup") & F.col("l.in")).alias("pi"), F.count_if(~F.col("_markup") & ~F.col("l.in")).alias("po")]
    lines = seen.groupBy("_host", F.col("l.u").alias("u")).agg(*counts).withColumn("n", F.col("si") + F.col("so") + F.col("pi") + F.col("po")).where("n >= 2")
    lines = written(lines.join(hosts, "_host").where(F.col("n") >= LEAST_SHARE * F.col("_pages")), "lines")
    every = lines.groupBy("u").agg(F.sum("si").alias("gi"), F.sum("so").alias("go")).where("gi + go >= 2")
    told = lines.join(every, "u", "left").withColumn("side", F.coalesce(_side("so", "si"), _side("go", "gi"), _side("po", "pi")))
    usual = _bound(F.col("n") / F.col("_pages"), F.col("_pages"), Z_RECURRENT, -1) > RECURRENT
    arrays = [F.collect_list(F.when(w, F.col("u"))).alias(a) for w, a in ((F.col("side"), "_known"), (~F.col("side"), "_body"), (usual, "_usual"))]
    return hosts.join(told.groupBy("_host").agg(*arrays), "_host", "left")  # at most a page's lines / LEAST_SHARE a host


def _informed(read: DataFrame) -> DataFrame:
    """The pages read, each with those of its own lines that are known of its host."""
    model = written(learned(read), "hosts")
    size = model.agg(F.sum(64 + 8 * (F.coalesce(F.size("_known"), F.lit(0)) + F.coalesce(F.size("_body"), F.lit(0)) + F.coalesce(F.size("_usual"), F.lit(0))))).first()[0] or 0
    both = read.join(F.broadcast(model) if size <= BROADCAST_BYTES else model, "_host")
    return both.select("_key", "_page", "_pages", *[F.array_intersect("_all", F.coalesce(a, F.array().cast("array<bigint>"))).alias(a) for a in ("_known", "_body", "_usual")])


def _judged(p: pd.DataFrame) -> Iterator[tuple[W.Page, list[int]]]:
    for blob, known, body, pages in zip(p["_page"], p["_known"], p["_body"], p["_pages"], strict=True):
        page = W.Page(*pickle.loads(blob))  # noqa: S301  (written by _read)
        yield page, W.judged(page, set(known), set(body), pages)


def _bodies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield pd.DataFrame({"_key": p["_key"], "_lines": [[r for r, w in zip(page.row, where, strict=True) if w == W.IN] for page, where in _judged(p)]})


def _ready(snapshots: DataFrame, id: str, url: str, title: str, content: str, judge: bool) -> tuple[DataFrame, DataFrame]:
    pages = _pages(snapshots, id, url, title, content)
    read = written(_distinct(pages).select("_key", "_host", "_name", "_content").mapInPandas(lambda parts: _read(parts, judge), READ), "read")
    return pages, _informed(read)


def main_body(snapshots: DataFrame, id: str = "id", url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """id, line_no: the lines of each page's main body, counted from 0 in content split at line feeds; each id and line once.

    A page is read through the standard library's parser; per line, visible text is set against the tags there, the ratios are smoothed by a
    Gaussian and clustered in two. The region (element below which the page divides) with most text of the upper cluster is the main body, and so
    is every other one whose text of that cluster outweighs its known lines and lines of links; where no elements divide the lines, the body
    reaches from the first line of the upper cluster to the last. Which lines recur on a host, inside of these bodies or outside, is counted
    over all its pages; lines that recur outside are known to stand around bodies and are left out wherever they stand, with small boxes of such
    lines; lines that recur inside are of the body wherever they stand. No wording is given: menus, footers and promotions are learned.
    A product's name by itself is the page's only if its address (or title) says so. A host of very few pages teaches nothing: the ratios decide.
    Pages of a null, empty or blank content, and rows without an id, give no rows; so does an empty table. Boxes may lie in each other to any depth.
    A row delivered twice (same id) counts once; if its copies differ, the one with the least key counts.
    """
    pages, read = _ready(snapshots, id, url, title, content, False)
    bodies = read.mapInPandas(_bodies, "_key string, _lines array<int>").where(F.size("_lines") > 0)
    return pages.groupBy("_id").agg(F.min("_key").alias("_key")).join(bodies, "_key").select(F.col("_id").alias("id"), F.explode("_lines").alias("line_no"))


def shown(page: W.Page, where: list[int], usual: set[int]) -> list[str]:
    """The kinds of evidence that a page's main body (or, without one, its text for clients without scripts) holds once its host's boilerplate is subtracted.

    A recurrent line is subtracted if the page keeps other text without it: a line without evidence that doesn't recur. A line that only says to
    wait or go on counts where nothing else is left.
    """
    lines = [(k, u[0]) for k, u, w in zip(page.kinds, page.units, where, strict=True) if w == W.IN] or [(k or None, u) for k, u in page.notes]
    rest = any(k is None and u not in usual for k, u in lines)
    kinds = {"failure" if k == "interim" else k for k, u in lines if k and not (rest and (u in usual or k == "interim"))}
    return sorted(kinds)


def _residues(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        yield pd.DataFrame({"_key": p["_key"], "kinds": [shown(page, where, set(u)) for (page, where), u in zip(_judged(p), p["_usual"], strict=True)]})


def residue(snapshots: DataFrame, id: str = "id", url: str = "url", title: str = "title", content: str = "content") -> DataFrame:
    """id, kinds: the rows whose main body shows an unfilled placeholder, filler, or an error, maintenance, access, robot-check or script demand.

    All normalised lines of all pages are counted by host, as hashes of whole lines over its distinct pages; a line on more than RECURRENT of them
    (by the lower bound of that share, so that few pages show nothing) is the host's boilerplate and is subtracted from pages that keep other
    text of the main body. A page with nothing else is what the line says (an outage, a robot check) and keeps it, however many pages say so. What
    remains is judged by its words (see page_residue). Text in noscript counts only where there is no main body at all.
    status_code isn't read. kinds: the sorted kinds of evidence. Null, empty and blank contents, and rows without an id, give no rows.
    A row delivered twice counts once. A host with a third of all pages is only ever counted, not gathered.
    """
    pages, read = _ready(snapshots, id, url, title, content, True)
    marked = read.mapInPandas(_residues, "_key string, kinds array<string>").where(F.size("kinds") > 0)
    return pages.select("_id", "_key").join(marked, "_key").groupBy(F.col("_id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"))
