"""Ranked lexical search by presence-mask grouping.

The documents are indexed once: per document its length and the terms of the stated items it holds. A task then takes
its documents in chunks. For each item the bitmaps of the item's terms over the chunk are turned into one presence mask
per document, documents with the same mask form a group, and the groups are scored by descending greatest possible
score until no group left can reach the best that is already held.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import doc_ids, rebatch, utf8
from tidemark.session import cut_lineage

BEST = 20
#: Items are taken in blocks of about this many bytes of text, so what is broadcast does not grow with them.
BLOCK_BYTES = 8 << 20
#: A chunk of documents ends at either number; both bound memory and change no result.
CHUNK_DOCS, CHUNK_POSTINGS = 8192, 1 << 20
#: Partitions whose best documents are merged first, before the merges are merged.
MERGED = 1024

#: ASCII letters in lower case, digits and all bytes past ASCII as they are, anything else a blank.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_WORD_BYTES).split()


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the document), and the numbers and frequencies of the terms in `vocabulary` it holds."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        for batch in rebatch(rows, 1000):
            data, at = utf8(batch.column(1))
            raw = data.tobytes().translate(_WORD_BYTES)
            n, ends, held, times = [], [0], [], []
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                found = raw[s:e].split()
                counts = Counter(map(number, found))
                counts.pop(None, None)
                n.append(len(found))
                held.extend(counts.keys())
                times.extend(counts.values())
                ends.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (held, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def weight(documents: int, frequency: int) -> int:
    """What a term of an item counts for, the rarer the more."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class _Item:
    """The distinct terms of an item with their weights (times their repeats), and the best documents so far."""

    def __init__(self, numbers: np.ndarray, weights: np.ndarray) -> None:
        self.numbers, self.weights = numbers, weights
        self.scores = self.ids = np.empty(0, np.int64)

    def least(self) -> int:
        """A document that scores less can't be among the best."""
        return int(self.scores[-1]) if len(self.scores) == BEST else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[:BEST]
        first = first[scores[first] > 0]
        self.scores, self.ids = scores[first], ids[first]


class _Chunk:
    """Documents with their postings, by document and by term."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids, self.sizes, self.term = ids, sizes, term
        self.starts = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(ids)), sizes)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
        by_term = np.argsort(term, kind="stable")
        self.docs_by_term = of[by_term]
        held, first = np.unique(term[by_term], return_index=True)
        self.range_of = dict(zip(held.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(term)], strict=True), strict=True))
        most = np.maximum.reduceat(self.impact[by_term], first) if len(first) else first
        self.most = dict(zip(held.tolist(), most.tolist(), strict=True))

    def _scores(self, docs: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
        """Exact scores of documents that hold at least one posting each."""
        sizes = self.sizes[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[docs] - (ends - sizes), sizes)
        return np.add.reduceat(weight_of[self.term[at]] * self.impact[at], ends - sizes)

    def search(self, item: _Item, weight_of: np.ndarray) -> None:
        """Bring the item's best up to date with this chunk; `weight_of` is zero and is left so."""
        here = [k for k, t in enumerate(item.numbers.tolist()) if t in self.range_of]
        numbers = item.numbers[here].tolist()
        weights = item.weights[here]
        most = weights * np.array([self.most[t] for t in numbers], np.int64)
        if int(most.sum()) < item.least():
            return
        bitmaps = np.zeros((-len(here) % 64 + len(here), len(self.ids)), bool)
        for k, t in enumerate(numbers):
            start, end = self.range_of[t]
            bitmaps[k, self.docs_by_term[start:end]] = True
        words = np.ascontiguousarray(np.packbits(bitmaps, axis=0).T).view(np.uint64)
        some = np.flatnonzero(words.any(axis=1))
        if words.shape[1] == 1:
            masks, group = np.unique(words[some, 0], return_inverse=True)
            masks = masks[:, None]
        else:
            masks, group = np.unique(words[some], axis=0, return_inverse=True)
        present = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8), axis=1)[:, : len(here)]
        bound = present.astype(np.int64) @ most
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by_place = np.argsort(place[group.reshape(-1)], kind="stable")
        docs, bound = some[by_place], bound[order][place[group.reshape(-1)][by_place]]
        weight_of[item.numbers] = item.weights
        at, step = 0, 64
        while at < len(docs):
            step = min(step, int(np.searchsorted(-bound[at:], -item.least(), "right")))
            if step <= 0:
                break  # no group that is left can score enough
            part = docs[at : at + step]
            item.offer(self._scores(part, weight_of), self.ids[part])
            at, step = at + step, min(2 * max(step, 32), 2048)
        weight_of[item.numbers] = 0


def _search(index: DataFrame, items: list[tuple[int, list[int], list[int]]], size: int, documents: int, total: int) -> DataFrame:
    """item, doc_id, score: the best of each task."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
        held: list[tuple[np.ndarray, ...]] = []

        def whole() -> _Chunk:
            ids, n, sizes, term, tf = (np.concatenate(c) for c in zip(*held, strict=True))
            return _Chunk(ids, 75 + (25 * n * documents) // total, sizes, term, tf.astype(np.int64))

        for batch in rebatch(rows, 1000):
            term = batch.column(2)
            sizes = np.diff(term.offsets.to_numpy())
            flat = [c.flatten().to_numpy() for c in (term, batch.column(3))]
            held.append((doc_ids(batch.column(0)), batch.column(1).to_numpy(), sizes, *flat))
            if sum(len(h[0]) for h in held) >= CHUNK_DOCS or sum(len(h[3]) for h in held) >= CHUNK_POSTINGS:
                yield whole()
                held = []
        if held:
            yield whole()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {number: _Item(np.array(numbers), np.array(weights, np.int64)) for number, numbers, weights in sent.value}
        weight_of = np.zeros(size, np.int64)
        for chunk in chunks(rows):
            for item in of.values():
                chunk.search(item, weight_of)
        for number, item in of.items():
            if len(item.ids):
                same = pa.array(np.full(len(item.ids), number), pa.int64())
                yield pa.RecordBatch.from_arrays([same, pa.array(item.ids), pa.array(item.scores)], names=["item", "doc_id", "score"])

    return index.where("size(terms) > 0").select("doc_id", "n", "terms", "tf").mapInArrow(run, "item long, doc_id long, score long")


def _first(found: DataFrame, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= BEST)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 highest-scoring documents of each item, equal scores by ascending doc_id.

    A document without terms (null, empty or only punctuation) isn't counted and is never found; an item without terms
    that a document holds has no rows, as has every item over an empty table. Rows that repeat a doc_id are documents of
    their own; a null doc_id comes after all others. Benchmark rows equal in item_id and text are one item; rows that
    share only the item_id (a null one, too) are ranked each. Columns other than doc_id, text and item_id are ignored.

    Every task returns 20 documents an item at most, whatever it has read. Items are taken in blocks of bounded size,
    each against all documents.
    """
    spark = docs.sparkSession
    items = cut_lineage(benchmark.select("item_id", F.col("text").cast("binary").alias("text")).distinct())
    size = items.agg(F.coalesce(F.sum(F.length("text") + 16), F.lit(0))).first()[0]
    blocks = int(size) // BLOCK_BYTES + 1
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    results = []
    for b in range(blocks):
        texts = [(r.item_id, Counter(terms(bytes(r.text or b"")))) for r in items.where(block == b).collect()]  # one block
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, counts in texts for t in counts}))}
        index = cut_lineage(_index(docs, vocabulary))
        total = index.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weights = {r.term: weight(total.documents, r.df) for r in held.collect()}  # no more than the block's vocabulary
        asked = []
        for number, (_, counts) in enumerate(texts):
            useful = {vocabulary[t]: times * weights.get(vocabulary[t], 0) for t, times in counts.items()}
            useful = {t: w for t, w in sorted(useful.items()) if w > 0}
            if useful:
                asked.append((number, list(useful), list(useful.values())))
        found = _search(index, asked, len(vocabulary), total.documents, max(1, total.terms))
        merged = _first(found.withColumn("part", F.floor(F.spark_partition_id() / MERGED)), "item", "part").drop("rank")
        ranked = cut_lineage(_first(merged.drop("part"), "item"))
        names = spark.createDataFrame(
            [(number, item_id) for number, (item_id, _) in enumerate(texts)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}"
        )
        results.append(ranked.join(names, "item").select(
            "item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") < _NO_ID, F.col("doc_id")).alias("doc_id"), "score",
        ))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
