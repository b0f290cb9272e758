"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.text import folded
from sightline.plans.materialize import spread, written

#: A ranks file in tiktoken's form; byte-level, so no text is without tokens, and made for many languages.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:  # the pattern that byte-level BPE was published with
        pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if not Path(path).exists():  # the package has the file wherever it is installed
        import public_tokenizers

        path = public_tokenizers.path(Path(path).name)
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sized(parts: Iterator[pd.DataFrame], path: str, terms: bool) -> Iterator[pd.DataFrame]:
    encode = encoder(path).encode_ordinary
    for p in parts:
        ids = [np.asarray(encode(t), np.int64) for t in p["_text"]]
        out = p.drop(columns="_text").assign(tokens=[len(x) for x in ids])
        if terms:
            counts = [np.unique(x, return_counts=True) for x in ids]
            out["terms"], out["times"] = [c[0].tolist() for c in counts], [c[1].tolist() for c in counts]
        yield out


def sized(documents: DataFrame, tokenizer: str = TOKENIZER, terms: bool = False, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, source, key, tokens (and terms, times): each document that has text, with the number of its tokens, as a table in the shared folder.

    key is equal for equal texts; source is without blanks and capitals. Whole texts are encoded, where they are read: no text is shuffled (but where a table is read in
    fewer tasks than there are cores).
    Null and empty texts, which have no tokens, and rows without an id are left out.
    """
    rows = documents.select(F.col(id).cast("long").alias("id"), folded(F.col(source)).alias("source"), F.md5(F.col(text)).alias("key"), F.col(text).alias("_text")).where("id is not null and _text <> ''")
    schema = "id long, source string, key string, tokens long" + (", terms array<int>, times array<int>" if terms else "")
    return written(spread(rows, "id").mapInPandas(partial(_sized, path=tokenizer, terms=terms), schema), "sized")
