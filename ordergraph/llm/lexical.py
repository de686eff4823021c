"""Ranked lexical search by the Best Position Algorithm.

Every document that has terms is one row of an index: its length, and the
frequencies of the terms that items ask for.  Tasks read the index in blocks
of bounded size.  A block's postings become one list for each term, highest
impact first; an item reads its lists side by side, looks each new document up
in all of them, and marks the positions where it stands.  A list's best
position ends the run of marked positions from its top: no document that was
not looked up can have more than the impacts at these positions together.  An
item stops as soon as this bound is strictly below its k-th best score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: A term is a run of these bytes; only A-Z become lower case.
_TERM = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _TERM else 0x20 for b in range(256))
#: Items searched in one pass hold about so many (item, term) pairs; more items take more passes.
BLOCK_PAIRS = 1_000_000
#: Documents and postings of one block of the index.
BLOCK_DOCS, BLOCK_POSTINGS = 16384, 2_000_000
FIRST_DEPTH = 32


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a whole UTF-8 text, in order; none of a null."""
    return text.translate(FOLD).split() if text else []


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def length_factor(n: np.ndarray, docs: int, tokens: int) -> np.ndarray:
    """100 - 50 + ((50 * n * docs) div tokens), also where the product is beyond 64 bits."""
    if 50 * docs * int(n.max(initial=0)) < 1 << 62:
        return 50 + (50 * docs * n) // tokens
    return np.array([50 + (50 * docs * int(e)) // tokens for e in n], dtype=np.int64)


def impact(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


@dataclass
class Block:
    """Impact lists of some documents, and the postings of each document.

    ``term``, ``doc``, ``value``: postings in order of documents; ``starts``:
    where a document's begin.  ``slot``: a posting's place in the lists, which
    stand one after another, by falling impact and then by document.
    """

    term: np.ndarray
    doc: np.ndarray
    value: np.ndarray
    starts: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.doc, -self.value, self.term))
        self.slot = np.empty(len(order), dtype=np.int64)
        self.slot[order] = np.arange(len(order))
        self.list_doc, self.list_value = self.doc[order], self.value[order]
        self.lists, self.begin, self.length = np.unique(self.term[order], return_index=True, return_counts=True)

    def search(self, wanted: np.ndarray, k: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents for the wanted terms, their scores, and how many were looked up.

        ``asked`` is a scratch array over all terms, zero before and after.
        """
        at = np.searchsorted(self.lists, wanted)
        at = at[at < len(self.lists)]
        at = at[np.isin(self.lists[at], wanted)]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        begin, length = self.begin[at], self.length[at]
        base = np.cumsum(length) - length
        asked[self.lists[at]] = np.arange(1, len(at) + 1)
        seen = np.zeros(int(length.sum()) + 1, dtype=bool)  # the last is never seen
        known = np.zeros(len(self.starts) - 1, dtype=bool)
        docs, scores, depth, more = [], [], 0, FIRST_DEPTH
        while True:
            here = np.minimum(length - depth, more)
            live = here > 0
            size = here[live]
            if not len(size):
                break
            reads = np.repeat(begin[live] + depth - (np.cumsum(size) - size), size) + np.arange(size.sum())
            fresh = np.unique(self.list_doc[reads])
            fresh = fresh[~known[fresh]]
            known[fresh] = True
            depth, more = depth + more, more * 2
            if len(fresh):
                size = self.starts[fresh + 1] - self.starts[fresh]
                own = np.repeat(self.starts[fresh] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                which = asked[self.term[own]]
                hit, place = own[which > 0], which[which > 0] - 1
                seen[self.slot[hit] - begin[place] + base[place]] = True
                heads = np.flatnonzero(np.r_[True, self.doc[hit[1:]] != self.doc[hit[:-1]]])
                docs.append(self.doc[hit[heads]])
                scores.append(np.add.reduceat(self.value[hit], heads))
            unseen = np.flatnonzero(~seen)
            best = np.minimum(unseen[np.searchsorted(unseen, base)] - base, length)  # positions seen without a gap
            bound = np.where(best < length, self.list_value[begin + np.maximum(best, 1) - 1], 0).sum()
            found = sum(map(len, scores))
            if found >= k and np.partition(np.concatenate(scores), found - k)[found - k] > bound:
                break
        asked[self.lists[at]] = 0
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        top = np.lexsort((docs, -scores))[:k]
        return docs[top], scores[top], len(docs)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index put together, or cut, to blocks of bounded size."""
    held, docs, postings = [], 0, 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy())) if batch.num_rows else np.empty(0, int)
        at = 0
        while at < batch.num_rows:
            gone = int(ends[at - 1]) if at else 0
            to = min(int(np.searchsorted(ends, gone + max(BLOCK_POSTINGS - postings, 1), side="right")), at + BLOCK_DOCS - docs)
            to = max(to, at + 1)
            held.append(batch.slice(at, to - at))
            docs, postings, at = docs + to - at, postings + int(ends[to - 1]) - gone, to
            if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, docs, postings = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _search_block(docs: DataFrame, asking: list, k: int, scratch: Scratch, name: str) -> DataFrame:
    """item, doc (struct id), score: k best documents for each of the items ``asking`` (lists of terms)."""
    spark = docs.sparkSession
    words = sorted({t for each in asking for t in each})
    number = {t: j for j, t in enumerate(words)}
    items = [np.array(sorted(number[t] for t in each), dtype=np.int64) for each in asking]
    shared = spark.sparkContext.broadcast((number, items))
    id_type = docs.schema["d"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value[0]
        for batch in batches:
            keep, n, offsets, which, tfs = [], [], [0], [], []
            for j, text in enumerate(texts_of(batch.column(1))):
                found = terms(text)
                if found:
                    held = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                    keep.append(j)
                    n.append(len(found))
                    which += [t for t, _ in held]
                    tfs += [c for _, c in held]
                    offsets.append(len(which))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, kind)) for v, kind in ((which, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["d", "n", "terms", "tfs"])

    rows = scratch.save(docs.select("d", "x").mapInArrow(index, f"d {id_type}, n long, terms array<int>, tfs array<long>"), name)
    total = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    n_docs, n_tokens = total["docs"], total["tokens"] or 0
    weight = np.zeros(len(words), dtype=np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # one row a term of the items
        weight[r["t"]] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * r["df"] + 1))))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value[1]
        asked = np.zeros(len(weight), dtype=np.int32)
        for batch in blocks(batches):
            batch = batch.take(pa.compute.sort_indices(batch.column("d"), null_placement="at_end"))
            lists, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            term, doc = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), size)
            m = length_factor(batch.column("n").to_numpy(), n_docs, n_tokens)
            value = impact(weight[term], tf, m[doc])
            live = value > 0
            term, doc, value = term[live], doc[live], value[live]
            starts = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            block, out = Block(term, doc, value, starts), []
            for j, wanted in enumerate(items):
                best, scores, _ = block.search(wanted, k, asked)
                out.append((np.full(len(best), j), best, scores))
            item, best, scores = (np.concatenate(c) for c in zip(*out)) if out else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column("d").take(pa.array(best.astype(np.int64))), pa.array(scores.astype(np.int64))], ["item", "d", "score"])

    return rows.mapInArrow(rank, f"item int, d {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item.

    Terms are maximal runs of ASCII letters, digits and characters beyond
    ASCII, with A-Z in lower case.  A document's score sums, over the item's
    distinct terms, w * ((10^9 tf) div (1000 tf + 20 m)), with
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 50 + ((50 n N) div L),
    where N counts the documents that have terms and L their terms.  Equal
    scores are by ascending id.

    Every row of ``docs`` is a document: repeated rows are found each, a null
    id comes after others of its score; null and termless texts are no
    documents.  Item rows of one id (or with null ids) are one item with all
    their terms; an item without terms has no result.  Extra columns are not
    read.  Empty tables give an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lexical")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["i", "ts"])

    item_type = items.schema[item_id].dataType.simpleString()
    pairs = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("x"))
    pairs = scratch.save(pairs.mapInArrow(split, f"i {item_type}, ts array<binary>"), "items")
    held = pairs.agg(F.sum(F.size("ts"))).first()[0] or 0
    passes = max(1, -(-held // BLOCK_PAIRS))
    read = docs.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").cast("string").alias("x"))
    out = []
    for j in range(passes):
        mine: dict = {}
        for r in pairs.filter((F.size("ts") > 0) & (F.pmod(F.xxhash64("i"), F.lit(passes)) == j)).collect():  # about BLOCK_PAIRS terms
            mine.setdefault(r["i"], set()).update(map(bytes, r["ts"]))
        ids = spark.createDataFrame([(n, i) for n, i in enumerate(mine)], f"item int, item_id {item_type}")
        best = _search_block(read, list(mine.values()), k, scratch, f"index-{j}")
        by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("d")))
        part = F.pmod(F.xxhash64("d"), F.lit(64))
        best = best.withColumn("part", part).withColumn("r", by("item", "part")).filter(F.col("r") <= k).drop("r")
        best = best.withColumn("rank", by("item")).filter(F.col("rank") <= k)
        out.append(best.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("d").alias("doc_id"), "score"))
    found = out[0]
    for each in out[1:]:
        found = found.unionByName(each)
    return found
