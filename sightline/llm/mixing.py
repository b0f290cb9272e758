"""Mixing sources to target weights (problem 9): Pareto order sampling over whole copies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions.text import folded
from sightline.llm.tokens import TOKENIZER, sized
from sightline.plans.materialize import checked_broadcast, written

#: Stretches of the ranking whose sizes are added up first, so that only the one in which the target falls is gone through text by text.
CELLS = 1 << 16

PLAN = "mix_name string, source string, rate double, need double"


def _rates(rows: pd.DataFrame) -> pd.DataFrame:
    """How many copies of a text per document that holds it a source gives, so that copies, capped, come to the tokens needed.

    rows: of one mix and source, the tokens of its texts by how many documents hold them."""
    need, cap = float(rows["need"].iloc[0]), float(rows["max_repeats"].iloc[0])
    rows = rows.sort_values("held", ascending=False)
    held, size = rows["held"].to_numpy(float), rows["tokens"].to_numpy(float)
    full, rest, weight = 0.0, need, float((held * size).sum())
    rate = 0.0
    for h, s in zip(held, size, strict=True):  # the texts held most often reach the cap first
        rate = rest / weight if weight > 0 else 0.0
        if rate * h <= cap + 1e-12:
            break
        full += cap * s
        rest, weight = need - full, weight - h * s
    else:
        rate = cap
    return pd.DataFrame({"mix_name": rows["mix_name"].iloc[:1], "source": rows["source"].iloc[:1], "rate": [max(rate, 0.0)], "need": [need]})


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """In order of rank, the texts that fit into what is free, and the first that doesn't if that leaves less over than it would leave short: nothing but rank decides."""
    rows = rows.sort_values(["rank", "id"], ignore_index=True)
    free = float(rows["_free"].iloc[0])
    upto = rows["tokens"].to_numpy(float).cumsum()
    n = int((upto <= free).sum())
    if n < len(rows) and upto[n] - free < free - (upto[n - 1] if n else 0.0):
        n += 1
    return rows[["mix_name", "source", "id", "tokens"]].assign(copies=rows["sure"] + (rows.index < n))


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares). chosen: mix_name, source, doc_id, copies, tokens: the texts of each mix and how often each is used.
    shares: mix_name, source, target_share, reached_share, tokens, texts, most_copies, max_repeats.

    Documents with equal texts are one text, so that no repetition is hidden in copies: of the least id of those with a source, and of that one's
    source. Where sources mirror each other, a text so counts for one of them alone, as it may be used max_repeats times in all. total is the
    size of a mix in tokens; if none is given, the largest at which no source needs more than max_repeats of all its texts. A text should be
    used in proportion to the documents that hold it, up to max_repeats: the whole part of that number is certain; texts are then ranked by
    random odds over the odds of their fractional parts (Pareto order sampling), and the first are used once more, until the source's tokens are
    reached: the last text of the order is taken if that comes nearer, so a source is off by half a text at most, and no text is passed over for its length. Random numbers are hashes of text, mix and seed, so a run repeats exactly.

    A target without any text reaches 0; other sources keep their sizes. Targets with a null mix, source or share, or a share or max_repeats of 0
    or less, choose nothing; a target named twice counts as the sum of its shares and the least max_repeats. Null sources are in no mix.

    Plan: texts are encoded where they are read; sizes alone are shuffled. The ranking of a source isn't sorted in one task: its texts are
    counted in CELLS stretches of rank; only the texts of the stretch in which the target falls are gone through one by one.
    """
    wanted = targets.select("mix_name", folded(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    wanted = wanted.where("mix_name is not null and source is not null and target_share > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    docs = sized(documents, tokenizer).where("source is not null")
    texts = docs.groupBy("key").agg(F.min(F.struct("id", "source", "tokens")).alias("one"), F.count("*").alias("held"))
    texts = written(texts.select("key", "one.id", "one.source", "one.tokens", "held"), "texts")
    by_held = texts.groupBy("source", "held").agg(F.sum("tokens").alias("tokens"))
    have = by_held.groupBy("source").agg(F.sum("tokens").alias("have"))
    goal = wanted.join(have, "source").withColumn("_most", F.col("have") * F.col("max_repeats") / F.col("target_share"))
    size = F.lit(float(total)) if total is not None else F.min("_most").over(Window.partitionBy("mix_name"))
    goal = goal.withColumn("need", F.least(size * F.col("target_share"), (F.col("have") * F.col("max_repeats")).cast("double")))
    rates = goal.join(by_held, "source").groupBy("mix_name", "source").applyInPandas(_rates, PLAN)
    goal = goal.select("mix_name", "source", "max_repeats").join(rates, ["mix_name", "source"])
    # a row for each text and mix; the targets are a small table, broadcast if its counted rows are
    use = texts.join(checked_broadcast(written(goal, "goals"), 80), "source")
    e = F.least(F.col("rate") * F.col("held"), F.col("max_repeats").cast("double"))
    use = use.withColumn("sure", F.floor(e + 1e-9)).withColumn("pi", F.greatest(e - F.col("sure"), F.lit(0.0)))
    u = (F.pmod(F.xxhash64("key", "mix_name", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    use = use.withColumn("rank", F.when(F.col("pi") > 1e-9, odds / (1 + odds))).withColumn("cell", F.floor(F.col("rank") * CELLS))
    use = written(use.select("mix_name", "source", "id", "key", "tokens", "sure", "rank", "cell", "need"), "uses")
    # of each source and stretch: the tokens before it
    sure = use.groupBy("mix_name", "source").agg((F.max("need") - F.sum(F.col("sure") * F.col("tokens"))).alias("_left"))
    cells = use.where("cell is not null").groupBy("mix_name", "source", "cell").agg(F.sum("tokens").alias("_in"))
    upto = Window.partitionBy("mix_name", "source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("mix_name", "source", "cell", "_in", F.coalesce(F.sum("_in").over(upto), F.lit(0)).alias("_before"))
    cells = cells.join(sure, ["mix_name", "source"]).withColumn("_room", F.col("_left") - F.col("_before"))
    edge = F.min(F.when((F.col("_room") < F.col("_in")) & (F.col("_room") > 0), F.struct("cell", "_room")))  # the stretch in which the target falls
    marks = cells.groupBy("mix_name", "source").agg(F.max(F.when(F.col("_room") >= F.col("_in"), F.col("cell"))).alias("_last"), edge.alias("e"))
    marks = marks.select("mix_name", "source", "_last", F.col("e.cell").alias("_edge"), F.col("e._room").alias("_free"))
    use = use.join(checked_broadcast(written(marks, "marks"), 80), ["mix_name", "source"], "left")
    beside = F.col("cell") == F.col("_edge")
    picked = use.where(beside).select("mix_name", "source", "id", "tokens", "sure", "rank", "_free").groupBy("mix_name", "source").applyInPandas(_fill, "mix_name string, source string, id long, tokens long, copies int")
    before = (F.col("cell") <= F.col("_last")) & F.coalesce(F.col("cell") < F.col("_edge"), F.lit(True))
    others = use.where(~F.coalesce(beside, F.lit(False))).select("mix_name", "source", "id", "tokens", (F.col("sure") + F.coalesce(before, F.lit(False)).cast("int")).cast("int").alias("copies"))
    chosen = others.unionByName(picked).where("copies > 0").select("mix_name", "source", F.col("id").alias("doc_id"), "copies", "tokens")
    reached = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.count("*").alias("texts"), F.max("copies").alias("most_copies"))
    shares = wanted.join(reached, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    shares = shares.select(
        "mix_name", "source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), whole), F.lit(0.0)).alias("reached_share"), "tokens",
        F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )
    return chosen, shares
