import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ordergraph.llm import lexical, whitening

VECTORS = "vec_id long, embedding array<float>, row string, x int, n string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def vectors(width=6, n=90, seed=3):
    rng = np.random.default_rng(seed)
    made = [(k, [float(np.float32(v)) for v in row], "a", 1, "b") for k, row in enumerate(rng.normal(size=(n, width)) * np.arange(1, width + 1))]
    made += [(1000 + k, made[4][1], "a", 1, None) for k in range(60)]  # one vector holds many rows
    made += [(None, made[5][1], None, None, None), (2**53 + 1, made[6][1], None, None, None), (7, made[7][1], None, 1, None), (7, made[7][1], None, 1, None), (500, [0.0] * width, None, 1, None)]
    odd = [(901, None, "a", 1, "b"), (902, [], "a", 1, "b"), (903, [None] * width, "a", 1, "b"), (904, [math.nan] * width, "a", 1, "b"), (905, [math.inf] * width, "a", 1, "b"), (906, [1.0] * (width - 1), "a", 1, "b"), (907, [3e38] * width, "a", 1, "b")]
    return made, odd


def expected(rows, components, counts):
    x = [tuple(math.floor(64 * c) + 1_000_000 for c in r[1]) for r in rows]
    held = Counter(x)
    fit = [v for v, m in held.items() for _ in range(m if counts else 1)]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    white = {v: ((np.array([n * c - s for c, s in zip(v, sums)]) / n) @ axes) / np.sqrt(values) for v in held}
    exact = {v: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in held}
    return x, n, exact, white, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_whitening_against_brute_force(spark, weights):
    rows, odd = vectors()
    got = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS), components=4, weights=weights).collect()
    x, n, exact, white, share = expected(rows, 4, weights == "counts")
    assert sorted((str(r["row"]["vec_id"]) for r in got)) == sorted(str(r[0]) for r in rows)
    of = {r[0]: v for r, v in zip(rows, x)}
    signs = None
    for r in got:
        v = of[r["row"]["vec_id"]]
        assert r["n"] == n and int(r["deviation"]) == exact[v] and r["identity_error"] < 1e-9
        assert np.allclose(r["explained"], share, rtol=1e-9)
        signs = np.sign(np.array(r["whitened"]) * white[v]) if signs is None else signs
        assert np.allclose(np.array(r["whitened"]) * signs, white[v], atol=1e-9)


def test_whitening_of_few_and_of_no_vectors(spark):
    same = [(k, [1.0, 2.0, 3.0], None, None, None) for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(same, VECTORS)).collect()
    assert len(got) == 4 and all(r["whitened"] == [None] * 3 and r["deviation"] == 0 and r["explained"] == [None] * 3 for r in got)
    two = [*same, (9, [2.0, 2.0, 3.0], None, None, None)]
    got = whitening.whiten(spark.createDataFrame(two, VECTORS)).collect()
    assert all(np.isclose(abs(r["whitened"][0]), 1) and r["whitened"][1:] == [None, None] and r["identity_error"] < 1e-12 for r in got)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, None, None, None)], VECTORS)).collect() == []


def test_deviations_beyond_64_bits_are_exact(spark):
    big = [(k, [float(2**40 + 2**30 * k), float(k)], None, None, None) for k in range(5)]
    x = [[math.floor(64 * c) + 1_000_000 for c in r[1]] for r in big]
    sums = [sum(c) for c in zip(*x)]
    got = {r["row"]["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(big, VECTORS)).collect()}
    assert got == {k: sum((5 * c - s) ** 2 for c, s in zip(v, sums)) for k, v in enumerate(x)} and max(got.values()) > 2**63


DOCS = "doc_id long, text string, score long, rank string, item_id long"
WORDS = ["alpha", "Beta", "gamma", "été", "x1", "the", "of", "日本"]


def ranked(docs, items, k):
    found = [(d, [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n, tokens = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or ""))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, w in found:
            tf, m = Counter(w), 50 + ((50 * len(w) * n) // tokens)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in ts if t in tf)
            scores += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    docs = [(k, " ".join(rng.choice(WORDS) + (str(rng.randrange(9)) if rng.random() < 0.3 else "") + rng.choice(["", ",", "\x00", "\n", "_"]) for _ in range(rng.choice([1, 5, 40])))) for k in range(n)]
    docs += [(2**53 + 1, docs[0][1]), (-(2**63), docs[0][1]), (None, docs[1][1]), (5, docs[5][1]), (n + 1, None), (n + 2, ""), (n + 3, " .,- "), (n + 4, "the " * 20000)]
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 6)))) for k in range(12)] + [(None, "alpha the"), (3, "gamma, the"), (77, None), (78, "nowhere"), (2**53 + 1, "été")]
    return docs, items


@pytest.mark.parametrize("sizes", [(16384, 2_000_000, 32), (7, 40, 1), (1, 1, 2)])
def test_search_against_brute_force(spark, monkeypatch, sizes):
    for name, v in zip(("BLOCK_DOCS", "BLOCK_POSTINGS", "FIRST_DEPTH"), sizes):
        monkeypatch.setattr(lexical, name, v)
    docs, items = corpus(sizes[0], 150)
    df = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    for k in (3, 50):
        got = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.search(df, asked, k=k).collect()]
        assert sorted(got, key=str) == ranked(docs, items, k)


def test_search_of_many_passes_and_of_no_rows(spark, monkeypatch):
    docs, items = corpus(8, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK_PAIRS", 9)
    got = [tuple(r) for r in lexical.search(df, asked, k=5).collect()]
    assert sorted(got, key=str) == ranked(docs, items, 5)
    assert lexical.search(df.limit(0), asked).collect() == [] and lexical.search(df, asked.limit(0)).collect() == []


def test_search_stops_early_and_only_strictly_below():
    rng = np.random.default_rng(4)
    docs, lists = 20000, 3
    value = np.sort(rng.pareto(1.2, size=(lists, docs)) * 1000, axis=1)[:, ::-1].astype(np.int64) + 1
    of = np.stack([np.arange(docs), np.arange(docs), rng.permutation(docs)])  # two lists agree
    term, doc, val = np.repeat(np.arange(lists), docs), of.ravel(), value.ravel()
    order = np.lexsort((term, doc))
    block = lexical.Block(term[order], doc[order], val[order], np.arange(docs + 1) * lists)
    best, scores, looked = block.search(np.arange(lists), 10, np.zeros(lists, np.int32))
    total = np.bincount(doc, weights=val).astype(np.int64)
    want = np.lexsort((np.arange(docs), -total))[:10]
    assert best.tolist() == want.tolist() and scores.tolist() == total[want].tolist() and looked < docs // 2
    ties = lexical.Block(np.zeros(100, np.int64), np.arange(100), np.full(100, 7), np.arange(101))
    best, _, looked = ties.search(np.array([0]), 5, np.zeros(1, np.int32))
    assert best.tolist() == [0, 1, 2, 3, 4] and looked == 100  # equal scores: the bound is never strictly below


def test_blocks_of_the_index_are_bounded_and_whole(monkeypatch):
    import pyarrow as pa

    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 3, 50]) for _ in range(200)]
    rows = [(k, 9, list(range(n)), [1] * n) for k, n in enumerate(sizes)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("d", "n", "terms", "tfs"), r)) for r in rows[a : a + 37]], pa.schema([("d", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])) for a in range(0, 200, 37)]
    for docs, postings in ((16384, 2_000_000), (7, 40), (1, 1), (50, 60)):
        monkeypatch.setattr(lexical, "BLOCK_DOCS", docs)
        monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
        out = [b.to_pylist() for b in lexical.blocks(iter(batches))]
        assert [r["d"] for b in out for r in b] == list(range(200))
        assert [r["terms"] for b in out for r in b] == [r[2] for r in rows]
        assert all(len(b) <= docs and sum(len(r["terms"]) for r in b[:-1]) <= postings for b in out)  # a block ends with the document that fills it
