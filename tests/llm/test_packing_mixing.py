from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sightline.llm.mixing import mixed
from sightline.llm.packing import Index, fill, fill_report, packed
from sightline.llm.tokens import TOKENIZER, encoder

DOC = "doc_id long, text string, source string, key string, tokens int"
WORDS = "battery screen update cable phone manual camera sensor chip index page model code sticker hinge tray speaker panel build reset".split()


def docs(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 90)))) + f" {i}", [" A ", "a", "B", "c"][i % 4], "", 1) for i in range(n)]
    rows += [(n, None, "a", "", 0), (n + 1, "", "a", "", 0), (None, "lost", "a", "", 0), (n + 2, " ".join(WORDS * 200), None, "", 0), (n + 3, rows[0][1], "b", "", 0), (n + 4, rows[0][1], "b", "", 0)]
    return spark.createDataFrame(rows, DOC), rows


def sizes(rows):
    e = encoder(TOKENIZER)
    return {i: len(e.encode_ordinary(t)) for i, t, *_ in rows if i is not None and t}


def test_packing_places_every_token_once(spark):
    df, rows = docs(spark)
    caps = spark.createDataFrame([("s", 64, 1), ("m", 512, 1), ("m", 600, 1), ("bad", 0, 1), ("none", None, 1), (None, 9, 1)], "pack_name string, capacity_tokens int, container_id int")
    placed = packed(df, caps).toPandas()
    assert set(placed["pack_name"]) == {"s", "m"}
    want = sizes(rows)
    for pack, cap in (("s", 64), ("m", 512)):
        p = placed[placed["pack_name"] == pack]
        assert p.groupby("container_id")["n_tokens"].sum().max() <= cap
        assert p.groupby("doc_id")["n_tokens"].sum().to_dict() == want
        for doc, g in p.groupby("doc_id"):
            g = g.sort_values("piece_no")
            assert (len(g) == 1) == (want[doc] <= cap) and list(g["start_token"]) == list(range(0, want[doc], cap)) and (g["n_tokens"][:-1] == cap).all()
    report = {r["pack_name"]: r["unused_share"] for r in fill_report(packed(df, caps), caps).collect()}
    assert report["m"] < 0.1
    assert packed(df.limit(0), caps).count() == 0 and packed(df, caps.limit(0)).count() == 0


def test_fill_uses_neighbours_and_fits_best():
    size = np.array([60, 50, 40, 40, 30, 10])
    near = np.array([0, 0, 0, 9.0, 0, 1.0])
    boxes = fill(size, 100, lambda i: near)
    assert boxes[0] == [0, 3] and sorted(i for b in boxes for i in b) == list(range(6)) and all(size[b].sum() <= 100 for b in boxes)
    assert fill(np.array([], int), 10, lambda i: near) == []


def test_bm25_against_brute_force():
    rng = np.random.default_rng(0)
    terms = [np.unique(rng.integers(0, 40, 12)) for _ in range(30)]
    times = [rng.integers(1, 4, len(t)) for t in terms]
    length = np.array([t.sum() for t in times], float)
    idf = rng.random(64).astype(np.float32)
    index = Index(terms, times, length, idf, 20.0)
    for seed in (0, 7, 29):
        want = [sum(idf[t] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[d] / 20.0)) for t, f in zip(terms[d], times[d], strict=True) if t in set(terms[seed])) for d in range(30)]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)


@pytest.mark.parametrize("total", [None, 3000.0])
def test_mixing_reaches_shares(spark, total):
    df, rows = docs(spark, 600)
    targets = spark.createDataFrame([("x", "A", 0.5, 3), ("x", " b ", 0.3, 2), ("x", "c", 0.2, 1), ("y", "gone", 0.5, 1), ("y", "a", 0.5, 2), ("z", "a", None, 1), (None, "a", 1.0, 1), ("z", "b", 1.0, 0)], "mix_name string, source string, target_share double, max_repeats int")
    chosen, shares = mixed(df, targets, total=total)
    c = chosen.toPandas()
    n = sizes(rows)
    assert (c["tokens"] == c["doc_id"].map(n)).all() and not c.duplicated(["mix_name", "doc_id"]).any()
    assert rows[0][0] in n and not set(c["doc_id"]) & {603, 604}  # copies of document 0
    s = shares.toPandas().set_index(["mix_name", "source"])
    assert (s["most_copies"] <= s["max_repeats"]).all()
    x = s.loc["x"]
    assert (x["reached_share"] - x["target_share"]).abs().max() < 0.02
    if total:
        assert abs(x["tokens"].sum() - total) < 150
    assert s.loc[("y", "gone"), "tokens"] == 0 and ("z", "a") not in s.index
    again = mixed(df, targets, total=total)[0].toPandas()
    key = ["mix_name", "doc_id", "copies"]
    assert sorted(map(tuple, c[key].values)) == sorted(map(tuple, again[key].values))
    assert mixed(df.limit(0), targets)[0].count() == 0 and mixed(df, targets.limit(0))[1].count() == 0


def test_text_whose_least_copy_has_no_source_is_used(spark):
    df = spark.createDataFrame([(1, "the only text here", None), (2, "the only text here", "a"), (3, "the only text here", " A ")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", "a", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    assert [(r["doc_id"], r["copies"]) for r in mixed(df, targets)[0].collect()] == [(2, 2)]


def test_inclusion_near_the_cut_depends_on_odds_alone():
    """Over many seeds, short and long texts of one inclusion odds are chosen equally often."""
    from sightline.llm.mixing import _fill

    rng = np.random.default_rng(4)
    size = np.where(np.arange(60) % 2, 20, 400)
    chosen, seeds = np.zeros(60), 3000
    for _ in range(seeds):
        rows = pd.DataFrame({"mix_name": "m", "source": "s", "id": np.arange(60), "tokens": size, "sure": 0, "rank": rng.random(60), "_free": size.sum() / 2})
        got = _fill(rows)
        chosen[got["id"].to_numpy()] += got["copies"].to_numpy()
        assert abs((got["tokens"] * got["copies"]).sum() - size.sum() / 2) <= 200
    share = chosen / seeds
    assert abs(share[::2].mean() - share[1::2].mean()) < 0.02 and abs(share.mean() - 0.5) < 0.02


def test_shards_hold_the_nearest_neighbours(spark, monkeypatch):
    """Of the ten nearest by BM25 over all documents (brute force) to those with ids divisible by 20, the share that lies in the same shard."""
    from sightline.llm import packing as P

    from sightline.llm.tokens import TOKENIZER, encoder

    rng = np.random.default_rng(9)
    tokens = [encoder(TOKENIZER).decode([i]) for i in range(2000, 12_000)]
    tokens = rng.permutation([t for t in tokens if t.isascii() and t[:1] == " " and t[1:].isalpha() and len(t) > 4])[:2400]
    vocabulary = tokens.reshape(40, 60)
    rows = [(i, "".join(rng.choice(vocabulary[i * 7 % 40], 40)) + " the of and" * 3, "s") for i in range(1200)]
    terms, times = [], []
    for _, t, _ in rows:
        a, b = np.unique(encoder(TOKENIZER).encode_ordinary(t), return_counts=True)
        terms.append(a), times.append(b)
    df = np.bincount(np.concatenate(terms), minlength=encoder(TOKENIZER).n_vocab)
    idf = np.log1p((1200 - df + 0.5) / (df + 0.5)).astype(np.float32)
    length = np.array([t.sum() for t in times], float)
    monkeypatch.setattr(P, "COMMON_LEAST", 10_000)  # brute force scores all terms
    whole = P.Index(terms, times, length, idf, length.mean())
    sample = [P.heavy(a, b, idf) for a, b in zip(terms, times, strict=True)][:400]
    c = P.centroids(sample, len(idf))
    place = pd.concat(P._weighed(iter([pd.DataFrame({"id": range(1200), "terms": terms, "times": times})]), idf, c))["place"].to_numpy()
    shard = np.empty(1200, int)
    shard[np.lexsort((np.arange(1200), place))] = np.arange(1200) // 400
    found = []
    for i in range(0, 1200, 20):
        s = whole.scores(i)
        s[i] = -1
        found.append((shard[np.argsort(-s)[:10]] == shard[i]).mean())
    assert np.mean(found) >= 0.9


def test_carried_texts_are_placed_and_used_texts_cost_nothing():
    size = np.array([30, 20, 20, 10] * 40)
    told = []
    boxes = fill(size, 100, lambda i: np.zeros(160), lambda used: told.append(int(used.sum())))
    assert sorted(i for b in boxes for i in b) == list(range(160)) and len(told) >= 3 and told == sorted(told)
