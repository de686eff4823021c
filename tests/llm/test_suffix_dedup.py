import hashlib
import random

import numpy as np
import pytest

from ordergraph.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, row string, kept string, r long, n_bytes int"


def brute(texts, width):
    """Of each text: removed bytes, runs, rest."""
    where = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - width + 1):
            where[b[i : i + width]] = where.get(b[i : i + width], 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if where[b[i : i + width]] > 1:
                gone[i : i + width] = b"\x01" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def corpus(seed, width):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日 ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, texts = text(width // 3 + 5), [text(rng.randrange(1, 120)) for _ in range(25)]
    for k in range(0, 20, 2):  # a passage in many contexts
        at = rng.randrange(len(texts[k]) + 1)
        texts[k] = texts[k][:at] + passage + texts[k][at:]
    base = text(100)
    for k in range(6):  # near copies
        at = rng.randrange(len(base))
        texts.append(base[:at] + word() + base[at:])
    texts += [texts[1]] * 9 + [None, "", "x", "a" * (3 * width), "ab" * (2 * width), "a" * (width - 1), passage[: width // 4], "z" * width, "\x00" * (width + 3)]
    texts += [texts[3][: len(texts[3]) // 2] + texts[5], base + base]
    return [(None if k % 11 == 0 else k, t, "a", "b", 1, 2) for k, t in enumerate(texts)] + [(1, texts[1], "c", None, None, None)] * 2


def test_suffix_array_against_sorting():
    for seed in range(300):
        rng = random.Random(seed)
        s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(60))]
        assert sd.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    assert sd.suffix_array([]) == [] and sd.suffix_array([5] * 2000) == list(range(1999, -1, -1))


def test_every_string_is_in_one_segment_of_its_least_gram(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 700)
    rng = random.Random(2)
    for width, gram in ((30, 9), (17, 5), (40, 40)):
        texts = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 900))) for _ in range(12)] + [b"a" * 2000, b"ab" * 500, b"", None]
        seen, of = {}, {}
        for text, start, n, off, key in sd.scanned(texts, width, gram):
            for t, s, m, o, k in zip(text.tolist(), start.tolist(), n.tolist(), off.tolist(), key.tolist()):
                for i in range(m):
                    assert (t, s + i) not in seen
                    seen[t, s + i] = True
                    string = texts[t][s + i : s + i + width]
                    assert of.setdefault(string, (k, o - i)) == (k, o - i)  # equal strings: one anchor, at one place
                    assert 0 <= o - i <= width - gram
        assert len(seen) == sum(max(0, len(t or b"") - width + 1) for t in texts)


@pytest.mark.parametrize("seed", range(3))
def test_bins_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    width = [20, 33, 200][seed]
    core = bytes(rng.integers(97, 100, size=width // 2, dtype=np.uint8))
    texts, strings, offs = [], [], []
    for _ in range(60):
        a, b = bytes(rng.integers(97, 99, size=width // 2 + 3, dtype=np.uint8)), bytes(rng.integers(97, 99, size=width, dtype=np.uint8))
        if rng.random() < 0.7 and texts:
            other = texts[rng.integers(len(texts))]
            a = other[: len(a)] if rng.random() < 0.5 else a
            b = other[-len(b) :] if rng.random() < 0.5 else b
        off, n = len(a), int(rng.integers(1, width // 2))
        texts.append((a + core + b)[: n + width - 1])
        strings.append(len(texts[-1]) - width + 1)
        offs.append(off)
    copies = rng.integers(1, 3, size=len(texts))
    got = sd.repeated(texts, np.array(strings), np.array(offs), copies, width)
    held = {}
    for t, n, o, m in zip(texts, strings, offs, copies):
        for i in range(n):
            held[t[i : i + width], o - i] = held.get((t[i : i + width], o - i), 0) + m
    for t, n, o, marks in zip(texts, strings, offs, got):
        assert marks.tolist() == [held[t[i : i + width], o - i] > 1 for i in range(n)]


@pytest.mark.parametrize("width,many,chunk", [(40, 20_000, 1 << 19), (200, 20_000, 1 << 19), (30, 2, 500)])
def test_removal_against_brute_force(spark, monkeypatch, width, many, chunk):
    for name, v in (("MANY", many), ("CHUNK", chunk), ("BIN", 4000)):
        monkeypatch.setattr(sd, name, v)
    rows = corpus(width, width)
    want = sorted(zip([str(r[0]) for r in rows], brute([r[1] for r in rows], width)), key=str)
    out = sd.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), width)
    got = out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans").collect()
    assert sorted(((str(r[0]), (r[1], r[2], r[3], bytes(r[4]))) for r in got), key=str) == want
    assert all(len(r["spans"]) == r["n_spans"] and sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert sum(w[1][1] for w in want) > 1000


def test_removal_of_no_and_of_short_texts(spark):
    assert sd.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    short = [(2**53 + 1, "kurz", "a", "b", 1, 2), (None, None, "a", "b", 1, 2), (-(2**63), "kurz", "a", "b", 1, 2)]
    out = sd.remove_repeats(spark.createDataFrame(short, SCHEMA)).collect()
    assert sorted(str(r["row"]["doc_id"]) for r in out) == sorted(str(r[0]) for r in short)
    assert all(r["n_removed"] == 0 and hashlib.sha256(r["kept"]).hexdigest() for r in out)
