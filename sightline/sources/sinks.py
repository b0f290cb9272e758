"""What leaves: tables, reports and the outcome of attempts to deliver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGE = 2000


def truncated(text: Column, most: int = MESSAGE) -> Column:
    """A text cut to a length, the cut marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def attempt_outcome(status: Column, error: Column) -> Column:
    """What became of one attempt: delivered, or why not."""
    return F.when(error.isNotNull(), error).when(status.between(200, 299), "delivered").when(status == 429, "rate_limited").when(status.between(400, 499), "client_error").when(status >= 500, "server_error").otherwise("invalid_request")


def delivery_outcome(attempts: DataFrame, key: str, order: str = "attempt") -> DataFrame:
    """key, attempts, delivered, outcome: a delivery by its attempts; its outcome is that of the last."""
    o = attempts.withColumn("_o", attempt_outcome(F.col("status_code"), F.col("error")))
    return o.groupBy(key).agg(F.count("*").alias("attempts"), F.max(F.col("_o") == "delivered").alias("delivered"), F.max_by("_o", order).alias("outcome"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small result as a Markdown table; more than `most` rows are refused rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def markdown_lines(df: DataFrame, heading: str, fields: dict[str, str]) -> DataFrame:
    """Adds `markdown`: each row as a document of its own, made where the row is."""
    lines = [F.concat(F.lit("# "), F.coalesce(F.col(heading).cast("string"), F.lit("")))] + [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"- {label}: "), F.col(c).cast("string"))) for c, label in fields.items()]
    return df.withColumn("markdown", F.concat_ws("\n", *lines))
