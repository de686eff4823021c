"""Approximate nearest neighbours: inverted lists with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample; every vector is
indexed.  Lists are dealt out in blocks of bounded size, and so are the
queries that probe a list; a task compares one block of each by asymmetric
distance tables, reranks the best exactly, and a partial top-k merges blocks.
Nothing is lost by codes or by lists: within a list, rows that the error of
their code could make nearer than the k-th are measured too, and then all lists
are searched whose radius does not rule them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, hash_share

BLOCK, QUERIES = 4096, 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids; an empty cluster takes a row drawn at random."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.choice(len(distinct), size=min(k, len(distinct)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(x, c)
        sums, n = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


class Quantiser:
    """Coarse centroids, and a codebook for each part of the residual."""

    def __init__(self, sample: np.ndarray, lists: int, parts: int, seed: int = 7):
        self.coarse = kmeans(sample, lists, seed=seed)
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
        self.spans = list(zip(edges[:-1], edges[1:]))
        self.books = [kmeans(rest[:, a:b], 256, rounds=6, seed=seed) for a, b in self.spans]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.coarse[lists]
        return np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.books)], axis=1).astype(np.uint8)

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        out = self.coarse[lists].copy()
        for k, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            out[:, a:b] += book[codes[:, k]]
        return out

    def tables(self, query: np.ndarray, at: int) -> np.ndarray:
        """Squared distances from the query's residual to each code, by part."""
        rest = query - self.coarse[at]
        out = np.full((len(self.spans), 256), np.inf)
        for k, ((a, b), book) in enumerate(zip(self.spans, self.books)):
            out[k, : len(book)] = ((book - rest[a:b]) ** 2).sum(axis=1)
        return out


def usable(v: Column) -> Column:
    """Not null, not all zero, every component finite."""
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return v.isNotNull() & F.coalesce(sound & F.exists(v, lambda e: e != 0), F.lit(False))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    lists: int = 128,
    parts: int = 16,
    probe: int = 80,
    rerank: int = 100,
    sample: int = 16384,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query.

    Nearness is Euclidean distance in double precision, ties to the smaller
    id.  ``probe`` lists are searched, and more until they hold
    ``4 * rerank`` vectors (all, in a small table); ``rerank`` candidates of a
    list's block are measured exactly, and so is every row whose distance from
    its code, less the code's error, is not above the k-th.  In a second round
    a query asks the other lists, but those that lie farther than the k-th by
    the distance of the centroid less the list's radius.  So no neighbour is
    missed, whatever the rows; rows without structure ask nearly all lists.  The quantiser is fitted on about
    ``sample`` vectors, those of least hash; every vector is indexed.

    Null, zero and non-finite vectors take no part, nor do those with a null
    id or of another length than the first sampled one.  Rows with one id
    count once, with the least of their vectors.  No usable rows: no result.
    """
    every = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("q"))
    every = every.filter(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    total = every.count()
    drawn = every.filter(hash_share(F.xxhash64("id"), sample, total)).select("v", "id").collect()  # about ``sample`` rows
    drawn.sort(key=lambda r: (r["id"], r["v"]))
    empty = "query_id long, rank int, vec_id long, score double"
    if not drawn:
        return vectors.sparkSession.createDataFrame([], empty)
    width = len(drawn[0]["v"])
    fit = np.array([r["v"] for r in drawn if len(r["v"]) == width])
    model = Quantiser(fit, max(1, min(lists, len(fit) // 32)), parts)
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    every = every.filter(F.size("v") == width)

    @F.pandas_udf("list int, codes binary, wrong double, away double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            x = np.stack([np.asarray(v, dtype=float) for v in batch]) if len(batch) else np.empty((0, width))
            at = nearest(x, m.coarse)
            codes = m.codes(x, at) if len(x) else np.empty((0, 1), dtype=np.uint8)
            wrong = np.sqrt(((x - m.decoded(codes, at)) ** 2).sum(axis=1)) if len(x) else np.empty(0)
            yield pd.DataFrame({"list": at.astype(np.int32), "codes": [c.tobytes() for c in codes], "wrong": wrong, "away": np.sqrt(((x - m.coarse[at]) ** 2).sum(axis=1))})

    index = checkpoint(every.select("id", "v", "q", place("v").alias("at")).select("id", "v", "q", "at.*"))
    of_list = index.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()  # at most ``lists`` rows
    held, radius = {r["list"]: r["n"] for r in of_list}, np.full(len(model.coarse), -np.inf)
    radius[[r["list"] for r in of_list]] = [r["radius"] for r in of_list]
    held_n = np.array([held.get(j, 0) for j in range(len(model.coarse))])

    def split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists in the order of their centroids' distance, those of the first round and the others, and these distances."""
        d = ((shared.value.coarse - v) ** 2).sum(axis=1)
        order = d.argsort(kind="stable")
        enough = max(probe, int(np.searchsorted(np.cumsum(held_n[order]), 4 * rerank)) + 1)
        return order[:enough], order[enough:], np.sqrt(d)

    @F.pandas_udf("array<int>")
    def probes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([split(np.asarray(v, dtype=float))[0].astype(np.int32) for v in batch])

    @F.pandas_udf("array<int>")
    def others(vs: pd.Series, limits: pd.Series) -> pd.Series:
        out = []
        for v, limit in zip(vs, limits):
            v = np.asarray(v, dtype=float)
            _, rest, d = split(v)
            out.append(rest[d[rest] - radius[rest] <= limit + slack(v, d[rest])].astype(np.int32))
        return pd.Series(out)

    def slack(v: np.ndarray, d: np.ndarray) -> np.ndarray:
        """More than rounding can change a distance by."""
        return 1e-7 * (d + np.sqrt((v * v).sum()))

    spark = vectors.sparkSession

    def look(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score from the lists that the rows (id, v, limit, list) ask."""
        asked = checkpoint(asked)
        asking = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
        blocks = {j: -(-n // BLOCK) for j, n in held.items()}
        groups = {j: -(-n // QUERIES) for j, n in asking.items()}
        sizes = spark.createDataFrame([(j, blocks[j], groups.get(j, 0)) for j in held], "list int, blocks int, groups int")  # at most ``lists`` rows
        dealt = lambda df, own, other: df.join(F.broadcast(sizes), "list").withColumn(own[0], F.pmod(F.xxhash64("id", "list"), F.col(own[1]))).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)))
        there = dealt(index.filter(F.col("list").isin([j for j in asking])) if asking else index.limit(0), ("b", "blocks"), ("g", "groups")).select("list", "b", F.col("g").cast("long").alias("g"), "id", "v", "codes", "wrong")
        here = dealt(asked, ("g", "groups"), ("b", "blocks")).select(F.col("list").alias("q_list"), F.col("b").cast("long").alias("q_b"), F.col("g").alias("q_g"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), F.col("limit").alias("q_limit"))
        return here.groupBy("q_list", "q_b", "q_g").cogroup(there.groupBy("list", "b", "g")).applyInPandas(compare, "query_id long, vec_id long, score double")

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            m, at = shared.value, int(rows["list"].iloc[0])
            rows = rows.sort_values("id", kind="stable")
            ids, x = rows["id"].to_numpy(), np.stack([np.asarray(v, dtype=float) for v in rows["v"]])
            codes = np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1)
            part = np.arange(codes.shape[1])[None, :]
            wrong = rows["wrong"].to_numpy()
            for q, v, limit in zip(queries["q_id"], queries["q_v"], queries["q_limit"]):
                v = np.asarray(v, dtype=float)
                rough = m.tables(v, at)[part, codes].sum(axis=1)
                rough[ids == q] = np.inf
                best = np.argsort(rough, kind="stable")[:rerank] if len(rough) > rerank else np.arange(len(rough))
                best = best[ids[best] != q]
                exact = np.sqrt(((x[best] - v) ** 2).sum(axis=1))
                bound = min(limit, np.partition(exact, k - 1)[k - 1]) if len(exact) >= k else limit
                rough = np.sqrt(rough)
                near = rough - wrong <= bound + slack(v, rough + wrong)
                near[best], near[ids == q] = False, False
                more = np.flatnonzero(near)
                best, exact = np.concatenate([best, more]), np.concatenate([exact, np.sqrt(((x[more] - v) ** 2).sum(axis=1))])
                top = np.lexsort((ids[best], exact))[:k]
                out += [(q, int(ids[best[t]]), float(exact[t])) for t in top]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    ranked = lambda found: found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    ask = lambda df, lists: df.select("id", "v", "limit", F.explode(lists).alias("list"))
    queries = index.filter("q").select("id", "v")
    first = checkpoint(ranked(look(ask(queries.withColumn("limit", F.lit(float("inf"))), probes("v")))))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("limit"))
    limited = queries.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    return ranked(first.select("query_id", "vec_id", "score").unionByName(look(ask(limited, others("v", "limit")))))
