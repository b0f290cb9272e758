"""Filling containers of fixed capacity with texts (problem 8): lexical retrieval packing over a sharded BM25 inverted index."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.tokens import TOKENIZER, encoder, sized
from sightline.plans.materialize import written

#: Documents in one shard of the index, at least; and so many containers of the largest capacity. Shards are ranges of a lexical order, so that neighbours mostly share one.
SHARD, CONTAINERS = 4096, 16
#: The lexical order: CLUSTERS centroids, fitted in ROUNDS to the HEAVY weightiest terms of a sample of SAMPLE documents, those with the least hashes of their ids.
CLUSTERS, ROUNDS, SAMPLE, HEAVY = 64, 8, 4096, 256
#: Terms of more than this share of a shard's documents (and COMMON_LEAST of them) tell no neighbours and are not scored.
COMMON, COMMON_LEAST = 0.125, 64
#: BM25's constants.
K1, B = 1.2, 0.75
#: A container filled less than this is taken apart, its texts going on to the next shard, once; only there, and in the last shard of a partition, some are left.
FULL = 0.985
#: The largest number of packs (capacities); they are read to the driver.
MOST_PACKS = 1000

PLACED = "pack_name string, container_id string, doc_id long, piece_no int, start_token long, n_tokens long"


class Index:
    """An inverted index over one shard: for each term, the documents with it and their BM25 weights."""

    def __init__(self, terms: list[np.ndarray], times: list[np.ndarray], length: np.ndarray, idf: np.ndarray, mean: float):
        n = len(terms)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        term = np.concatenate(terms) if n else np.zeros(0, np.int64)
        tf = np.concatenate(times).astype(np.float32) if n else np.zeros(0, np.float32)
        norm = K1 * (1 - B + B * length / max(mean, 1e-9))
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        order = np.argsort(term, kind="stable")
        self.n, self.of, self.idf = n, terms, idf
        self._laid(term[order], doc[order], weight[order])

    def _laid(self, term: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.doc, self.weight = term, doc, weight
        self.terms, first, count = np.unique(term, return_index=True, return_counts=True)
        self.first, self.last = first, first + count
        self.told = count <= max(COMMON_LEAST, COMMON * self.n)

    def without(self, used: np.ndarray) -> Index:
        """The index without the documents used, so that they cost nothing more."""
        left = ~used[self.doc]
        self._laid(self.term[left], self.doc[left], self.weight[left])
        return self

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for a seed document's terms."""
        mine = self.of[seed]
        at = np.searchsorted(self.terms, mine[self.idf[mine] > 0])
        at = at[(at < len(self.terms))]
        at = at[np.isin(self.terms[at], mine) & self.told[at]] if len(at) else at
        if not len(at):
            return np.zeros(self.n)
        spans = [slice(a, b) for a, b in zip(self.first[at].tolist(), self.last[at].tolist(), strict=True)]
        return np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)


def ranked(score: np.ndarray, among: np.ndarray, few: int = 128) -> Iterator[int]:
    """Items by falling score, of equal scores the lower number first; the first few are found without sorting all."""
    if len(among) > few:
        top = np.partition(score[among], len(among) - few)[len(among) - few]
        first = among[score[among] > top]
        yield from first[np.argsort(-score[first], kind="stable")].tolist()
        among = among[score[among] <= top]
    yield from among[np.argsort(-score[among], kind="stable")].tolist()


def fill(sizes: np.ndarray, capacity: int, neighbours: Callable[[int], np.ndarray], drop: Callable[[np.ndarray], object] | None = None) -> list[list[int]]:
    """Containers of items (none larger than capacity): each begins with the largest item left, takes its nearest neighbours that fit, and what then fits best.

    neighbours(seed): a score for each item. An item is used once. Ties go to the lower number. drop(used): told each time half of what was left is used.
    """
    left = sorted((int(s), -i) for i, s in enumerate(sizes))  # by size; of equal sizes the lower number is taken first
    unused = np.ones(len(sizes), bool)
    out, mark = [], len(sizes) // 2

    def take(pos: int) -> int:
        i = -left.pop(pos)[1]
        unused[i] = False
        return i

    while left:
        if drop and len(left) <= mark:
            drop(~unused)
            mark = len(left) // 2
        seed = take(len(left) - 1)
        box, room = [seed], capacity - int(sizes[seed])
        if left and left[0][0] <= room:
            score = neighbours(seed)
            for i in ranked(score, np.flatnonzero(unused & (score > 0) & (sizes <= room))):
                s = int(sizes[i])
                if s > room:
                    continue
                rest = room - s
                if rest and rest < left[0][0]:  # nothing would fit beside it: the rest is left to the best fit
                    continue
                left.pop(bisect_right(left, (s, -int(i))) - 1)
                unused[i] = False
                box.append(int(i))
                room = rest
                if not left or room < left[0][0]:
                    break
            while left and room >= left[0][0]:
                i = take(bisect_right(left, (room, 1)) - 1)
                box.append(i)
                room -= int(sizes[i])
        out.append(box)
    return out


def heavy(terms: np.ndarray, times: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's weightiest terms and their weights, of length 1."""
    terms = np.asarray(terms, np.int64)
    w = idf[terms] * np.minimum(np.asarray(times, np.float32), 3)
    if len(w) > HEAVY:
        top = np.argpartition(-w, HEAVY)[:HEAVY]
        terms, w = terms[top], w[top]
    return terms, (w / max(float(np.linalg.norm(w)), 1e-9)).astype(np.float32)


def centroids(sample: list[tuple[np.ndarray, np.ndarray]], size: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means over a sample: a column for each cluster, in an order in which each is followed by the most similar one left."""
    k = min(CLUSTERS, len(sample))
    c = np.zeros((size, k), np.float32)
    for j, i in enumerate(np.random.default_rng(seed).choice(len(sample), k, replace=False)):
        c[sample[i][0], j] = sample[i][1]
    for _ in range(ROUNDS):
        new = np.zeros_like(c)
        for t, w in sample:
            new[t, int(np.argmax(w @ c[t]))] += w
        c = new / np.maximum(np.linalg.norm(new, axis=0), 1e-9)
    alike, chain, left = c.T @ c, [0] if k else [], set(range(1, k))
    while left:
        chain.append(max(left, key=lambda j: alike[chain[-1], j]))
        left.discard(chain[-1])
    return c[:, chain]


def _weighed(parts: Iterator[pd.DataFrame], idf: np.ndarray, c: np.ndarray) -> Iterator[pd.DataFrame]:
    """Adds where a document lies in the lexical order: its nearest centroid, then its second nearest."""
    for p in parts:
        place = []
        for t, n in zip(p["terms"], p["times"], strict=True):
            t, w = heavy(t, n, idf)
            near = np.argsort(-(w @ c[t]), kind="stable")[:2] if c.shape[1] else [0]
            place.append(int(near[0]) * CLUSTERS + int(near[-1]))
        yield p.assign(place=place)


def _sampled(parts: Iterator[pd.DataFrame], idf: np.ndarray) -> Iterator[pd.DataFrame]:
    for p in parts:
        both = [heavy(t, n, idf) for t, n in zip(p["terms"], p["times"], strict=True)]
        yield pd.DataFrame({"t": [a.tolist() for a, _ in both], "w": [b.tolist() for _, b in both]})


def _pack(parts: Iterator[pd.DataFrame], packs: list[tuple[str, int]], idf: np.ndarray, mean: float) -> Iterator[pd.DataFrame]:
    """Packs the documents of a partition, which come in lexical order, shard by shard, into containers of each pack."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    made = {name: 0 for name, _ in packs}
    carried: dict[str, list[tuple]] = {name: [] for name, _ in packs}  # (doc, piece, start, size, terms, times, tokens) of containers taken apart
    enough = CONTAINERS * max((c for _, c in packs), default=0)

    def shard(rows: list[tuple], last: bool) -> Iterator[pd.DataFrame]:
        for name, capacity in packs:
            out, items, old = [], list(carried[name]), len(carried[name])
            for doc, tokens, terms, times in rows:
                whole, rest = divmod(tokens, capacity)
                for piece in range(whole):  # full by themselves; only a text longer than the capacity has more than one piece
                    made[name] += 1
                    out.append((name, f"{name}-{task}-{made[name]}", doc, piece, piece * capacity, capacity))
                if rest:
                    items.append((doc, whole, whole * capacity, rest, terms, times, tokens))
            carried[name] = []
            if items:
                sizes = np.array([x[3] for x in items], np.int64)
                index = Index([x[4] for x in items], [x[5] for x in items], np.array([x[6] for x in items], float), idf, mean)
                for box in fill(sizes, capacity, index.scores, index.without):
                    if not last and sizes[box].sum() < FULL * capacity and min(box) >= old:
                        carried[name] += [items[i] for i in box]
                        continue
                    made[name] += 1
                    out += [(name, f"{name}-{task}-{made[name]}", *items[i][:4]) for i in box]
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACED.split(", ")])

    held: list[tuple] = []
    much = 0
    for p in parts:
        for doc, tokens, terms, times in zip(p["id"], p["tokens"], p["terms"], p["times"], strict=True):
            held.append((int(doc), int(tokens), np.asarray(terms, np.int64), np.asarray(times, np.int64)))
            much += int(tokens)
            if len(held) >= SHARD and much >= enough:
                yield from shard(held, False)
                held, much = [], 0
    yield from shard(held, True)


def packed(documents: DataFrame, capacities: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """pack_name, container_id, doc_id, piece_no, start_token, n_tokens: where each document (or piece of one longer than the capacity) lies.

    Each document is put into containers of every pack once. It is split only if it is longer than the capacity: into pieces as long as the
    capacity, each a container of its own, and one piece of the rest. Documents without text have no tokens and aren't placed. Capacities that
    are null or below 1 make no containers; of a pack named twice the least capacity counts.

    Token counts of terms over all documents give BM25's weights (one number for each id of the vocabulary, so the table that tasks get is bounded).
    Documents are put in a lexical order, by the centroids nearest to them (fitted to a bounded sample), and cut in ranges; each range is read in shards
    of SHARD documents or more.
    A shard's inverted index gives the unused neighbours of each seed, the longest text left, which fill its container greedily; what is left
    of it takes the text that fits best. Containers filled less than FULL are taken apart and go on to the next shard.
    """
    rows = capacities.select("pack_name", F.col("capacity_tokens").cast("long").alias("c")).where("pack_name is not null and c >= 1").groupBy("pack_name").agg(F.min("c").alias("c")).orderBy("pack_name").limit(MOST_PACKS + 1).collect()
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    docs = sized(documents, tokenizer, terms=True)
    total = docs.agg(F.count("*").alias("n"), F.avg("tokens").alias("mean")).first()
    counts = docs.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # a row for each id of the vocabulary at most
    df = np.zeros(encoder(tokenizer).n_vocab)
    for t, c in counts:
        df[t] = c
    idf = np.log1p((total["n"] - df + 0.5) / (df + 0.5)).astype(np.float32)
    spark = documents.sparkSession
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), (total["n"] or 0) // SHARD))
    sample = docs.select("id", "terms", "times").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).mapInPandas(partial(_sampled, idf=idf), "t array<int>, w array<float>").collect()
    c = centroids([(np.array(r["t"], np.int64), np.array(r["w"], np.float32)) for r in sample], len(df))
    placed = docs.mapInPandas(partial(_weighed, idf=idf, c=c), "id long, source string, key string, tokens long, terms array<int>, times array<int>, place int").select("place", "id", "tokens", "terms", "times")
    ordered = written(placed, "placed").repartitionByRange(n, "place", "id").sortWithinPartitions("place", "id")
    packs = [(r["pack_name"], int(r["c"])) for r in rows]
    return ordered.mapInPandas(partial(_pack, packs=packs, idf=idf, mean=float(total["mean"] or 0)), PLACED)


def fill_report(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """pack_name, capacity_tokens, containers, texts, tokens, unused_share: how full a pack's containers are."""
    caps = capacities.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).where("pack_name is not null and capacity_tokens >= 1").groupBy("pack_name").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    by = placed.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("p")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("p").alias("pieces"), F.sum("t").alias("tokens"))
    return caps.join(by, "pack_name").select("pack_name", "capacity_tokens", "containers", "pieces", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused_share"))
