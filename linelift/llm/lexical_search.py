"""Ranked lexical search: a hybrid of term-at-a-time and document-at-a-time over index segments.

Items are searched in blocks of bounded size. For a block, one pass over the documents writes an
inverted index of the block's terms in segments of bounded numbers of documents and words;
lists are sorted by document. Corpus statistics are counts over that index. Then each
item meets each segment:

- Its short lists are worked off term at a time into summed accumulators, once. These are
  then one iterator over documents like any other, bounded by its largest sum.
- The iterator and the long lists are worked off document at a time, a window of documents at
  once. Each has an upper bound. The weakest ones whose bounds together stay below the item's
  k-th best score so far only look up documents that the others bring (binary search, so the
  rest of their postings is skipped), and only while a document can still reach that score.

A task keeps the k best documents of each item; they meet in two small ranking steps. Scores are
exact integers; a document is only left out if k better ones (or equal ones with smaller ids)
are known.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linelift.llm.common import drop_tables, materialize, need_columns, ship_package

TOP = 10
BLOCK_BYTES = 8 << 20
"""Bytes of item texts in one block (an item of more has a block to itself)."""
SEGMENT_DOCS = 4096
SEGMENT_WORDS = 1 << 20
"""Words in a segment; one document may have more."""
SLICE_BYTES = 4 << 20
"""Longer texts are cut into words in slices that end between terms."""
SHORT_SHARE = 32
"""A list is short if it holds at most one in this many documents of a segment."""
WINDOW_DOCS = 1024
SALTS = 64

# Of a text in lower case (A to Z only): on UTF-8 bytes these are digits, letters and all
# characters beyond ASCII.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

SEGMENT = ("ids array<long>, sizes array<long>, terms array<int>, lengths array<int>, "
           "docs array<int>, counts array<int>")
FOUND = "item int, item_id long, doc_id long, score long"


def terms(text: str) -> list[bytes]:
    return _TERM.findall(text.encode().lower())


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a lower-cased text, in lists of bounded length."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + SLICE_BYTES) if len(data) - at > SLICE_BYTES else None
        end = gap.start() if gap else len(data)
        yield _TERM.findall(data, at, end)
        at = end


class Block(NamedTuple):
    """Items of one block: ids, and the distinct terms of each with their numbers of occurrences."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def make_block(rows: Iterable[Row]) -> Block:
    out = Block([], {}, [], [])
    for item_id, text in rows:
        count = Counter(terms(text or ""))
        out.ids.append(item_id)
        out.terms.append(np.array([out.vocabulary.setdefault(t, len(out.vocabulary)) for t in count], np.int64))
        out.repeats.append(np.array(list(count.values()), np.int64))
    return out


def _blocks(items: DataFrame) -> Iterator[list[Row]]:
    rows, size = [], 0
    for row in items.toLocalIterator():
        if rows and size + len(row["text"]) > BLOCK_BYTES:
            yield rows
            rows, size = [], 0
        rows.append(row)
        size += len(row["text"])
    if rows:
        yield rows


def _segments(vocabulary):
    """(doc_id, text) -> segments of the inverted index; documents without a term are left out."""

    def flush(ids: list, sizes: list, found: list) -> pa.RecordBatch:
        keys = np.concatenate([np.int64(len(ids)) * t + at for at, t in enumerate(found)])
        keys, counts = np.unique(keys, return_counts=True)
        held, lengths = np.unique(keys // len(ids), return_counts=True)
        columns = (ids, sizes, held, lengths, keys % len(ids), counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([c], pa.list_(t)) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 4)],
            ["ids", "sizes", "terms", "lengths", "docs", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        ids, sizes, found, words = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                size, parts = 0, []
                for some in _slices((text.as_py() or b"").lower()):
                    size += len(some)
                    known = [k for k in map(number, some) if k is not None]
                    parts.append(np.array(known, np.int64))
                if size:
                    ids.append(doc_id)
                    sizes.append(size)
                    found.append(np.concatenate(parts))
                    words += len(found[-1])
                if len(ids) >= SEGMENT_DOCS or words >= SEGMENT_WORDS:
                    yield flush(ids, sizes, found)
                    ids, sizes, found, words = [], [], [], 0
        if ids:
            yield flush(ids, sizes, found)

    return run


class Best:
    """The k best documents of an item: highest score, then smallest id (null ones last)."""

    def __init__(self, k: int):
        self.k, self.floor = k, 0
        self.rows = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]  # score, null, id

    def add(self, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:  # those below the k-th best of them can't stay
            least = np.partition(score, -self.k)[-self.k]
            at = score >= least
            score, null, ids = score[at], null[at], ids[at]
        rows = [np.concatenate(pair) for pair in zip(self.rows, (score, null, ids))]
        order = np.lexsort((rows[2], rows[1], -rows[0]))[:self.k]
        self.rows = [r[order] for r in rows]
        if len(order) == self.k:
            self.floor = int(self.rows[0][-1])


class Segment:
    """An index segment with the score part of each posting, (10^9 tf) div (1000 tf + 8 m)."""

    def __init__(self, ids, sizes, terms, lengths, docs, counts, corpus: tuple[int, int], known: int):
        n_docs, n_words = corpus
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        m = np.array([100 - 75 + 75 * n * n_docs // n_words for n in sizes], np.int64)
        self.docs, tf = docs.astype(np.int64), counts.astype(np.int64)
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        self.place = np.full(known, -1, np.int64)
        self.place[terms] = np.arange(len(terms))
        self.lengths = lengths.astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.most = np.maximum.reduceat(self.part, self.ends - self.lengths) if len(terms) else self.part

    def postings(self, at: int) -> slice:
        return slice(self.ends[at] - self.lengths[at], self.ends[at])

    def search(self, item_terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Offer ``best`` the documents of this segment that may be among an item's k best."""
        at = self.place[item_terms]
        here = (at >= 0) & (weights > 0)
        at, weights = at[here], weights[here]
        if not len(at):
            return
        bounds = weights * self.most[at]
        if bounds.sum() < best.floor:
            return
        short = self.lengths[at] * SHORT_SHARE <= len(self.ids)
        lists = [(int(b), self.docs[s], self.part[s] * w) for b, s, w in zip(
            bounds[~short], map(self.postings, at[~short]), weights[~short])]
        if short.any():
            docs, sums = self._accumulate(at[short], weights[short])
            lists.append((int(sums.max()), docs, sums))
        lists.sort(key=lambda x: -x[0])
        # what the lists from each one on can add
        rest = np.cumsum([0, *(x[0] for x in reversed(lists))])[::-1].tolist()
        for start in range(0, len(self.ids), WINDOW_DOCS):
            self._window(start, min(start + WINDOW_DOCS, len(self.ids)), lists, rest, best)

    def _accumulate(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: (documents, summed scores) of short lists."""
        spots = [self.postings(a) for a in at]
        docs = np.concatenate([self.docs[s] for s in spots])
        scores = np.concatenate([self.part[s] * w for s, w in zip(spots, weights)])
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        return docs[first], np.add.reduceat(scores[order], first)

    def _window(self, start: int, end: int, lists: list, rest: list, best: Best) -> None:
        """Document at a time, for the documents from start to end."""
        if rest[0] < best.floor:
            return
        # lists that must bring a document themselves: what follows them cannot reach the floor
        leading = next((k for k in range(len(lists)) if rest[k] < best.floor), len(lists))
        scores = np.zeros(end - start, np.int64)
        for _, docs, parts in lists[:leading]:
            a, b = np.searchsorted(docs, (start, end))
            scores[docs[a:b] - start] += parts[a:b]
        found = np.flatnonzero(scores)
        scores = scores[found]
        for k in range(leading, len(lists)):
            alive = scores + rest[k] >= best.floor
            found, scores = found[alive], scores[alive]
            if not len(found):
                return
            _, docs, parts = lists[k]
            spot = np.minimum(np.searchsorted(docs, found + start), len(docs) - 1)
            scores = scores + np.where(docs[spot] == found + start, parts[spot], 0)
        alive = scores >= max(best.floor, 1)
        if alive.any():
            at = found[alive] + start
            best.add(scores[alive], self.null[at], self.ids[at])


def _search(given, k: int):
    """Segments -> the k best documents of each item among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, corpus = given.value
        best = [Best(k) for _ in block.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, *arrays = (c[row].values for c in batch.columns)
                segment = Segment(ids.to_pylist(), sizes.to_pylist(), *[a.to_numpy() for a in arrays],
                                  corpus, len(weights))
                for own, repeats, kept in zip(block.terms, block.repeats, best):
                    segment.search(own, weights[own] * repeats, kept)
        out: list[list] = [[], [], [], []]
        for item, (item_id, kept) in enumerate(zip(block.ids, best)):
            for score, null, doc_id in zip(*[r.tolist() for r in kept.rows]):
                for column, value in zip(out, (item, item_id, None if null else doc_id, score)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, [pa.int32()] + [pa.int64()] * 3)],
            ["item", "item_id", "doc_id", "score"])

    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def ranked_search(docs: DataFrame, items: DataFrame, *, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of ``docs`` (doc_id, text) for each item (item_id, text).

    Rows: item_id, rank (from 1), doc_id, score; fewer than ``top`` if fewer score above 0, none for an
    item that has no term in common with any document. Equal scores rank by ascending doc_id.

    Null or empty texts have no terms; a document without terms counts nowhere. Repeated
    document rows are documents of their own; rows of ``items`` that agree in id and text are one
    item, those that only share an id are ranked each by itself. A null doc_id ranks after others of
    its score. Other columns are ignored; without documents or items there are no rows.
    """
    need_columns(docs, "doc_id", "text")
    need_columns(items, "item_id", "text")
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = (items.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .where(F.col("text") != "").distinct())
    results = []
    for rows in _blocks(items):
        block = make_block(rows)
        vocabulary = spark.sparkContext.broadcast(block.vocabulary)
        index = materialize(docs.mapInArrow(_segments(vocabulary), SEGMENT), "search-index")
        corpus = index.agg(F.sum(F.size("ids").cast("long")), F.sum(F.aggregate(
            "sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
        if corpus[0]:
            held = (index.select(F.explode(F.arrays_zip("terms", "lengths")).alias("t"))
                    .groupBy("t.terms").agg(F.sum("t.lengths")).toArrow())
            df = np.zeros(len(block.vocabulary), np.int64)
            df[held.column(0).to_numpy()] = held.column(1).to_numpy()
            weights = np.array([term_weight(corpus[0], int(n)) for n in df], np.int64)
            given = spark.sparkContext.broadcast((block._replace(vocabulary={}), weights, tuple(corpus)))
            found = index.mapInArrow(_search(given, top), FOUND)
            order = [F.desc("score"), F.asc_nulls_last("doc_id")]
            some = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
                    .withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order)))
                    .where(F.col("rank") <= top))
            results.append(materialize(
                some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order)))
                .where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"), "search-found"))
            given.destroy()
        vocabulary.destroy()
        drop_tables(index)
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
