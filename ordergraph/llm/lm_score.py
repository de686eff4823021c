"""Cross-entropy difference: matched target and background n-gram models.

Both are interpolated bigram models over one shared vocabulary, counted over
the whole corpus.  Documents are gathered into chunks of bounded text.  Each
chunk sends its distinct n-grams, as 64-bit hashes of context and word, to the
parts of the table that own them; a part adds up what all chunks send and
answers each chunk with the counts that it asked for.  The number of parts
grows with the input, and the driver gets three numbers.  A document's own
n-grams are taken out of both models before it is scored, so that no document
is scored by a model that was made from it.  Its score is the mean over its
tokens of target loss minus background loss (low: like the target).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, packed
from .shingles import MIX, ODD, WordHashes, mixed

START = np.uint64(0x5851F42D4C957F2D)
#: Bytes of words in a chunk; one longer document is a chunk of its own.
CHUNK = 1 << 23
#: Bits of an n-gram's hash that are cut off: 56 stay, of which sorted differences are stored.
CUT = np.uint64(8)


def _squeezed(a: np.ndarray) -> bytes:
    """The numbers byte by byte, compressed."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _restored(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(blob, decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(kind).ravel()


def chunks_of(docs: DataFrame, target: DataFrame, doc_id: str, text: str) -> DataFrame:
    """chunk, n_docs, n_tokens, size, words (compressed), ids (two hashes a document), flags (is target)."""
    d, x = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    rows = docs.select(d.alias("d"), x.alias("x"), *_identity(d, x))
    marked = rows.join(target, F.col("d") == F.col("t"), "left").select("x", "i", "j", F.col("t").isNotNull().alias("is_target"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        texts, ids, flags, size, tokens = [], [], [], 0, 0

        def chunk() -> pd.DataFrame:
            raw = b"\n".join(texts)
            row = (first, len(texts), tokens, len(raw), pa.compress(raw, codec="zstd", asbytes=True), np.array(ids, dtype=np.int64).tobytes(), np.array(flags, dtype=np.uint8).tobytes())
            return pd.DataFrame([row], columns=["chunk", "n_docs", "n_tokens", "size", "words", "ids", "flags"])

        for batch in batches:
            for x, i, j, is_target in zip(batch["x"], batch["i"], batch["j"], batch["is_target"]):
                words = (x if isinstance(x, str) else "").encode("utf-8", "surrogatepass").lower().split()
                joined = b" ".join(words)
                if texts and size + len(joined) > CHUNK:
                    yield chunk()
                    first, texts, ids, flags, size, tokens = first + 1, [], [], [], 0, 0
                texts.append(joined)
                ids.append((i, j))
                flags.append(is_target)
                size, tokens = size + len(joined) + 1, tokens + len(words)
        if texts:
            yield chunk()

    return marked.mapInPandas(run, "chunk long, n_docs int, n_tokens long, size long, words binary, ids binary, flags binary")


def _identity(d, x) -> list:
    return [F.xxhash64(d, x).alias("i"), F.xxhash64(F.lit(1), d, x).alias("j")]


def _keys(words: bytes, size: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: its unigram, context and bigram; and the tokens of each document."""
    raw = pa.decompress(words, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    lengths = np.array([x.count(b" ") + 1 if x else 0 for x in raw.split(b"\n")])
    every = raw.split()
    h = np.fromiter(map(hashes.__getitem__, every), dtype=np.uint64, count=len(every))
    before = np.roll(h, 1)
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return mixed(h) >> CUT, mixed(before ^ ODD[4]) >> CUT, mixed(before * MIX + h) >> CUT, lengths


def _own(document: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each token, how often its own document has the n-gram ``at``."""
    each = document * np.int64(at.max(initial=0) + 1) + at
    _, inverse, n = np.unique(each, return_inverse=True, return_counts=True)
    return n[inverse]


def _requests(chunks: DataFrame, parts: int) -> DataFrame:
    """chunk, part, kind (0 unigrams, 1 contexts and bigrams), m sorted distinct keys, their counts in all and in target documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for c in batch.itertuples():
                one, context, two, lengths = _keys(c.words, c.size, hashes)
                wanted = np.repeat(np.frombuffer(c.flags, dtype=np.uint8), lengths)
                out = []
                for kind, keys, marks in ((0, one, wanted), (1, np.concatenate([context, two]), np.concatenate([wanted, wanted]))):
                    if not len(keys):
                        continue
                    found, at, n = np.unique(keys, return_inverse=True, return_counts=True)
                    t = np.bincount(at, weights=marks, minlength=len(found)).astype(np.int32)
                    part = ((found >> np.uint64(24)) * np.uint64(parts)) >> np.uint64(32)  # in the order of the keys
                    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(found)]
                    for a, b in zip(edges, edges[1:]):
                        out.append((c.chunk, int(part[a]), kind, b - a, _squeezed(np.diff(found[a:b], prepend=np.uint64(0))), _squeezed(n[a:b].astype(np.int32)), _squeezed(t[a:b])))
                yield pd.DataFrame(out, columns=["chunk", "part", "kind", "m", "keys", "n", "t"])

    return chunks.select("chunk", "size", "words", "flags").mapInPandas(run, "chunk long, part int, kind int, m int, keys binary, n binary, t binary")


def _answers(requests: DataFrame) -> DataFrame:
    """chunk, kind, part, m, n, t: the counts over all chunks; n_words, all_n, all_t: of the part's unigrams, in one of its rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows in group.groupby("kind"):
            sent = list(rows.itertuples())
            keys = np.concatenate([np.cumsum(_restored(r.keys, r.m, np.uint64), dtype=np.uint64) for r in sent])
            found, at = np.unique(keys, return_inverse=True)
            n, t = (np.bincount(at, weights=np.concatenate([_restored(getattr(r, c), r.m, np.int32) for r in sent])).astype(np.int64) for c in ("n", "t"))
            all_of = (len(found), int(n.sum()), int(t.sum())) if kind == 0 else (0, 0, 0)
            start = 0
            for r in sent:
                mine = at[start : start + r.m]
                out.append((r.chunk, kind, r.part, r.m, _squeezed(n[mine]), _squeezed(t[mine]), *all_of))
                start, all_of = start + r.m, (0, 0, 0)
        return pd.DataFrame(out, columns=["chunk", "kind", "part", "m", "n", "t", "n_words", "all_n", "all_t"])

    return requests.groupBy("part").applyInPandas(run, "chunk long, kind int, part int, m int, n binary, t binary, n_words long, all_n long, all_t long")


def score_documents(
    docs: DataFrame,
    target: DataFrame,
    bits: int = 21,
    weight: float = 0.5,
    alpha: float = 0.1,
    broadcast_docs: int = 1 << 19,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Columns row, n_tokens, target_loss, background_loss, score.

    ``target`` has the ids of target documents in column t.  The target model
    is made from all of them; their ids are broadcast if there are at most
    ``broadcast_docs``, else joined by a shuffle; the background model is that of the whole
    corpus.  A part of the table is asked for about 2**``bits`` n-grams,
    whatever the input; ``weight`` is the bigram's share and ``alpha`` the
    unigram's smoothing over the words of the corpus, the vocabulary that both
    models share.

    No tokens (null or empty text): null losses and score.  Null doc_id: scored
    and counted in the background.  Without target documents the target
    model is uniform.  Repeated rows count each time, and a document is taken
    out of the models once.  An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    ids = scratch.save(target.select(F.col("t").cast("long").alias("t")).filter("t is not null").distinct())
    ids = F.broadcast(ids) if ids.count() <= broadcast_docs else ids.hint("merge")
    chunks = scratch.save(chunks_of(docs, ids, doc_id, text))
    tokens = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    answers = scratch.save(_answers(_requests(chunks, 1 + (tokens >> bits))))
    n_words, all_n, all_t = (x or 0 for x in answers.agg(F.sum("n_words"), F.sum("all_n"), F.sum("all_t")).first())
    scores = _scored(chunks, answers.drop("n_words", "all_n", "all_t"), n_words, (all_t, all_n), weight, alpha)
    scores = scratch.save(scores.groupBy("i", "j").agg(F.first("s").alias("s")).select(F.col("i").alias("at_i"), F.col("j").alias("at_j"), "s"), "scores")
    scratch.clear(keep=("scores",))
    rows = packed(docs, **dict(zip("ij", _identity(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))))
    return rows.join(scores, (F.col("i") == F.col("at_i")) & (F.col("j") == F.col("at_j")), "left").select("row", "s.*")


def losses(one: np.ndarray, context: np.ndarray, two: np.ndarray, total: np.ndarray, words: int, weight: float, alpha: float) -> np.ndarray:
    """Losses of tokens, given the counts of each one's word, context and bigram, and of all words."""
    p = (one + alpha) / (total + alpha * words)
    p2 = np.where(context > 0, two / np.maximum(context, 1), p)
    return -np.log(weight * p2 + (1 - weight) * p)


def _scored(chunks: DataFrame, answers: DataFrame, n_words: int, totals: tuple[int, int], weight: float, alpha: float) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hashes, out = WordHashes(), []
        for c in left.itertuples():
            one, context, two, lengths = _keys(c.words, c.size, hashes)
            ids = np.frombuffer(c.ids, dtype=np.int64).reshape(-1, 2)
            frame = {"i": ids[:, 0], "j": ids[:, 1], "n_tokens": lengths, "target_loss": 0.0, "background_loss": 0.0}
            if len(one):
                got = {kind: list(r.sort_values("part").itertuples()) for kind, r in right.groupby("kind")}
                pairs = np.unique(np.concatenate([context, two]), return_inverse=True)[1]
                at = {"one": np.unique(one, return_inverse=True)[1], "context": pairs[: len(one)], "two": pairs[len(one) :]}
                document = np.repeat(np.arange(len(lengths)), lengths)
                own = {k: _own(document, v) for k, v in at.items()}
                marks = np.frombuffer(c.flags, dtype=np.uint8).astype(np.int64)
                for count, total, inside, name in (("t", totals[0], marks, "target_loss"), ("n", totals[1], np.ones_like(marks), "background_loss")):
                    every = {kind: np.concatenate([_restored(getattr(r, count), r.m, np.int64) for r in got[kind]]) for kind in (0, 1)}
                    n = {k: every[0 if k == "one" else 1][v] - own[k] * inside[document] for k, v in at.items()}
                    loss = losses(n["one"], n["context"], n["two"], (total - inside * lengths)[document], n_words, weight, alpha)
                    frame[name] = np.bincount(document, weights=loss, minlength=len(lengths)) / np.maximum(lengths, 1)
            out.append(pd.DataFrame(frame))
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("i", "j", "n_tokens", "target_loss", "background_loss")})

    schema = "i long, j long, n_tokens long, target_loss double, background_loss double"
    each = chunks.select("chunk", "size", "words", "ids", "flags").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)
    own = lambda c: F.when(F.col("n_tokens") > 0, c)
    t, b = F.col("target_loss"), F.col("background_loss")
    return each.select("i", "j", F.struct("n_tokens", own(t).alias("target_loss"), own(b).alias("background_loss"), own(t - b).alias("score")).alias("s"))
