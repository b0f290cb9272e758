"""What changed between full snapshots (problem 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import canonical_json
from sightline.functions.url import normal_url


def snapshot_changes(
    snapshots: DataFrame,
    source: str = "source",
    key: str = "url",
    sweep: str = "sweep_no",
    at: str = "fetched_at",
    tie: str = "id",
    hashes: Sequence[str] = ("content_hash", "text_hash", "dom_hash"),
    values: Sequence[str] = ("change_summary",),
) -> DataFrame:
    """source, url, sweep_no, change_kind (added, removed or changed), one row for each page and pair of successive sweeps of its source in which it differs.

    Of a page's rows in one sweep the one with the latest `at` counts (null is earliest; ties: the greatest `tie`), so rows delivered twice,
    or fetched twice, do no harm. A null hash or value on either side is no difference. A source's first sweep gives no rows. Rows without a
    source, key or sweep belong to no pair and are left out; an empty table gives no rows. Other columns, whatever their names, aren't read.

    Plan: a partial aggregate leaves one row per page and sweep before anything is shuffled, so a page fetched very often costs no task more
    than another; the sweeps of a source, a small aggregate of its own, give each row the sweeps before and after; then one window per page,
    which has no more rows than there are sweeps. lag() on the hashes tells changes; a gap in the sweeps tells removals and additions.
    """
    fields = [*hashes, *values]
    rows = snapshots.select(
        F.col(source).alias("_s"),
        normal_url(F.col(key)).alias("_k"),
        F.col(sweep).cast("long").alias("_n"),
        F.col(at).alias("_at"),
        F.col(tie).alias("_tie"),
        *[F.lower(F.col(c)).alias(f"_f{i}") for i, c in enumerate(hashes)],
        *[canonical_json(F.col(c)).alias(f"_f{i}") for i, c in enumerate(values, len(hashes))],
    ).where("_s is not null and _k is not null and _n is not null")
    every = [f"_f{i}" for i in range(len(fields))]
    page = rows.groupBy("_s", "_k", "_n").agg(F.max(F.struct("_at", "_tie", *every)).alias("_row")).select("_s", "_k", "_n", *[f"_row.{c}" for c in every])
    by_source = Window.partitionBy("_s").orderBy("_n")
    sweeps = rows.select("_s", "_n").distinct().select("_s", "_n", F.lag("_n").over(by_source).alias("_before"), F.lead("_n").over(by_source).alias("_after"))
    by_page = Window.partitionBy("_s", "_k").orderBy("_n")
    differs = F.lit(False)
    for c in every:
        differs = differs | F.coalesce(F.lag(c).over(by_page) != F.col(c), F.lit(False))
    seen = page.join(sweeps, ["_s", "_n"]).select(
        "_s", "_k", "_n", "_before", "_after", F.lag("_n").over(by_page).alias("_last"), F.lead("_n").over(by_page).alias("_next"), differs.alias("_differs")
    )
    here = F.when(F.col("_before").isNull(), F.lit(None)).when(F.col("_last").isNull() | (F.col("_last") < F.col("_before")), F.lit("added")).when(F.col("_differs"), F.lit("changed"))
    gone = F.col("_after").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_after")))
    events = F.filter(F.array(F.struct(F.col("_n").alias("n"), here.alias("kind")), F.struct(F.col("_after").alias("n"), F.when(gone, F.lit("removed")).alias("kind"))), lambda e: e["kind"].isNotNull())
    return seen.select("_s", "_k", F.explode(events).alias("_e")).select(
        F.col("_s").alias("source"), F.col("_k").alias("url"), F.col("_e.n").cast("int").alias("sweep_no"), F.col("_e.kind").alias("change_kind")
    )
