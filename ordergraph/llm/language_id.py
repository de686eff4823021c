"""Language ID: nearest centroids of normalised TF-IDF character n-grams.

The classifier is fitted on a bounded, documented sample of labelled rows: for
each language, several centroids by spherical k-means.  Every whole text is
then compared with all centroids by cosine, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

LETTER, OTHER = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"


def grams(text: str, dims: int) -> np.ndarray:
    """Counts of hashed character 1- to 3-grams of the letters, lower case, words apart."""
    points = np.frombuffer((" " + OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(dims)
    key = np.zeros(len(points), dtype=np.uint64)
    for n in range(min(3, len(points))):
        key = key[: len(points) - n] * np.uint64(1_000_003) + points[n:]
        cell = ((key + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        out += np.bincount((cell % np.uint64(dims)).astype(np.int64), minlength=dims)
    return out


@dataclass
class Centroids:
    idf: np.ndarray
    names: list[str]
    rows: np.ndarray
    limits: np.ndarray

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(grams(text, len(self.idf))) * self.idf
        return v / max(float(np.sqrt(v @ v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the text is too far from it."""
        if text is None or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        cosines = self.rows @ self.vector(text)
        k = int(cosines.argmax())
        return self.names[k], float(min(max(cosines[k], 0.0), 1.0)), bool(cosines[k] < self.limits[k])


def fit_counts(held: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dims: int, each: int, reject: float, seed: int = 7) -> Centroids:
    """Of texts as (cells, counts of their grams); one language's rows are dense at a time."""
    df = np.zeros(dims)
    for cells, _ in held:
        df[cells] += 1
    idf = np.log((1 + len(held)) / (1 + df)) + 1

    def vectors(some: np.ndarray) -> np.ndarray:
        x = np.zeros((len(some), dims))
        for row, k in zip(x, some):
            row[held[k][0]] = np.log1p(held[k][1])
        x *= idf
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)

    names, rows, limits = [], [], []
    rng = np.random.default_rng(seed)
    langs_of = np.array(langs)
    for lang in sorted(set(langs)):
        mine = vectors(np.flatnonzero(langs_of == lang))
        c = mine[rng.choice(len(mine), size=min(each, len(mine)), replace=False)]
        for _ in range(8):
            near = (mine @ c.T).argmax(axis=1)
            c = np.stack([mine[near == j].sum(axis=0) if (near == j).any() else mine[rng.integers(len(mine))] for j in range(len(c))])
            c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
        far = (mine @ c.T).max(axis=1)
        names += [lang] * len(c)
        rows.append(c)
        limits += [float(np.quantile(far, reject))] * len(c)
    return Centroids(idf, names, np.concatenate(rows), np.array(limits))


def fit(texts: list[str], langs: list[str], dims: int, each: int, reject: float, seed: int = 7) -> Centroids:
    counts = [grams(t, dims) for t in texts]
    return fit_counts([(np.flatnonzero(c), c[c > 0]) for c in counts], langs, dims, each, reject, seed)


def _below(wanted: int, total: int) -> int:
    """A bound on a uniform 64-bit hash that about ``wanted`` of ``total`` rows keep; all if there are no more."""
    return 2**63 - 1 if wanted >= total else -(2**63) + int(2**64 * (wanted / total)) - 1


def identify(
    docs: DataFrame,
    training: Column,
    per_language: int = 500,
    dims: int = 8192,
    centroids: int = 3,
    reject: float = 0.001,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Columns row, lang_pred, score, rejected.

    Fitted on about ``per_language`` rows of each language, those of least
    hash, among the rows where ``training`` holds and text and ``lang`` are not
    null.  What is collected is one row of at most ``dims`` counts for each of
    these, however long the texts.  score: cosine with the nearest
    centroid.  rejected: nearer to no centroid than all but a ``reject`` share
    of its language's training rows.

    Null text or none with a letter: ``und``, score 0, rejected.  Without any
    labelled row all are ``und``.  Ties: the first language by name.  Null ids
    and repeated rows are predicted as any other.  An empty table gives none.
    """
    labelled = docs.filter(training & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").rlike(r"\p{L}"))
    labelled = labelled.select(F.col(f"`{text}`").alias("x"), F.col(f"`{lang}`").alias("l"), F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).alias("h"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language

    @F.pandas_udf("cells array<int>, counts array<int>")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [grams(x, dims) for x in batch]
            yield pd.DataFrame({"cells": [np.flatnonzero(c).astype(np.int32) for c in found], "counts": [c[c > 0].astype(np.int32) for c in found]})

    shares = F.create_map(*[F.lit(v) for name, n in sorted(sizes.items()) for v in (name, _below(per_language, n))]) if sizes else None
    drawn = []
    if sizes:  # about ``per_language`` rows of each language
        low = labelled.filter(F.col("h") <= F.element_at(shares, F.col("l"))).dropDuplicates(["h", "l"])
        drawn = sorted(low.select("h", "l", counted("x").alias("c")).collect(), key=lambda r: (r["h"], r["l"]))
    held = [(np.array(r["c"]["cells"], dtype=np.int64), np.array(r["c"]["counts"], dtype=float)) for r in drawn]
    model = fit_counts(held, [r["l"] for r in drawn], dims, centroids, reject) if drawn else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            out = [m.predict(x if isinstance(x, str) else None) if m else (UNKNOWN, 0.0, True) for x in batch]
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return packed(docs, p=predict(F.col(f"`{text}`"))).select("row", "p.*")
