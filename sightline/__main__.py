"""python -m sightline list | run QUERY --data DIR [--to PATH --format parquet|csv|json|markdown] | explain QUERY --data DIR"""

from __future__ import annotations

import argparse
import importlib
import sys

REGISTRIES = {"sightline.queries.problems": "PROBLEMS", "sightline.queries.relational": "RELATIONAL", "sightline.queries.metrics": "METRICS", "sightline.queries.pages": "PAGES", "sightline.queries.streams": "STREAMS"}


def queries() -> dict:
    found: dict = {}
    for module, name in REGISTRIES.items():
        found |= getattr(importlib.import_module(module), name).queries
    return found


def main(args: list[str] | None = None, extra: dict | None = None) -> int:
    p = argparse.ArgumentParser(prog="sightline", description=__doc__)
    p.add_argument("command", choices=["list", "run", "explain"])
    p.add_argument("query", nargs="?")
    p.add_argument("--data")
    p.add_argument("--to")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "markdown"])
    p.add_argument("--rows", type=int, default=20)
    a = p.parse_args(args)
    known = queries() | (extra or {})
    if a.command == "list":
        print("\n".join(f"{k}: {(f.__doc__ or '').strip().splitlines()[0] if f.__doc__ else ''}" for k, f in known.items()))
        return 0
    if a.query not in known or not a.data:
        p.error("name a query of `list` and --data")
    from sightline.session import build_session
    from sightline.sources.sinks import markdown

    spark = build_session(f"sightline {a.query}")
    df = known[a.query](spark, a.data)
    if a.command == "explain":
        df.explain("formatted")
    elif not a.to:
        df.show(a.rows, truncate=False)
    elif a.format == "markdown":
        with open(a.to, "w") as f:
            f.write(markdown(df, a.query))
    else:
        df.write.mode("overwrite").format(a.format).option("header", True).save(a.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
