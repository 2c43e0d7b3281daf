"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over all documents counts in how many each benchmark word n-gram occurs. An item's
seeds are its rarer n-grams. A second pass finds the seeds in every whole text and
aligns the item's words with the window around each run of hits; the best local score over
the score of a perfect copy decides. Both passes are map-side (only the counts are
shuffled), so a passage that many documents share makes no hot key.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_WORDS`` words, each
broadcast and held against all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelift.llm.common import need_columns, ship_package, small
from linelift.llm.shingles import ngram_hashes, word_hashes

BLOCK_WORDS = 500_000
"""Words of the benchmark that are broadcast at a time: about 20 MB of arrays."""
N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
RARE_SHARE = 1000
"""An n-gram in at most one of this many documents is always a seed."""
ALIGNED_WORDS = 1 << 20
"""Words of items and windows (padded to the longest of each) that are aligned at a time; a single
longer window is aligned alone."""

_WORD = re.compile(r"\w+")


def text_words(text: str | None) -> np.ndarray:
    """Hashes of the words: lower-case runs of letters, digits and underscores."""
    return word_hashes(" ".join(_WORD.findall((text or "").lower())).encode())


@dataclass
class Block:
    """Items and their n-grams: ``grams`` sorted; entry i belongs to ``item[i]`` at ``at[i]``."""

    ids: list
    tokens: list          # word hashes of each item
    grams: np.ndarray
    item: np.ndarray
    at: np.ndarray


def make_block(items: list[tuple], n: int) -> Block:
    tokens = [text_words(text) for _, text in items]
    grams, item, at = [], [], []
    for i, t in enumerate(tokens):
        g = ngram_hashes(t, min(n, max(1, len(t)))) if len(t) else np.empty(0, np.uint64)
        grams.append(g)
        item.append(np.full(len(g), i, np.int32))
        at.append(np.arange(len(g), dtype=np.int32))
    grams, item, at = (np.concatenate(x) if x else np.empty(0, t) for x, t in (
        (grams, np.uint64), (item, np.int32), (at, np.int32)))
    order = np.argsort(grams, kind="stable")
    return Block([i for i, _ in items], tokens, grams[order], item[order], at[order])


def seeds_of(block: Block, df: dict, documents: int) -> Block:
    """The block with the seeds alone: of the n-grams that occur in any document, per item the
    rarer half, and all that occur in at most one of RARE_SHARE documents."""
    counts = np.array([df.get(int(g), 0) for g in block.grams], np.int64)
    occurs = counts > 0
    keep = occurs & (counts * RARE_SHARE <= documents)
    order = np.argsort(block.item, kind="stable")
    starts = np.searchsorted(block.item[order], np.arange(len(block.ids) + 1))
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            own = order[a:b]
            own = own[occurs[own]]
            if len(own):
                keep[own] |= counts[own] <= np.median(counts[own])
    return Block(block.ids, block.tokens, block.grams[keep], block.item[keep], block.at[keep])


class _Finder:
    """Positions of a sorted list of n-grams in texts; a bit table skips most lookups."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(grams >> np.uint64(42)).astype(np.int64)] = True
        self.last = np.searchsorted(grams, grams, side="right")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, index of the first equal entry) of the n-grams that are listed."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(42)).astype(np.int64)])
        if not len(at):
            return at, at
        index = np.searchsorted(self.grams, hashes[at])
        index[index == len(self.grams)] = 0
        same = self.grams[index] == hashes[at]
        return at[same], index[same]


def local_scores(a: np.ndarray, a_len: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best Smith-Waterman scores of word sequences a[k, :a_len[k]] against b[k] (padded with
    0, which matches nothing), all pairs at once, one anti-diagonal at a time."""
    pairs, rows = a.shape
    cols = b.shape[1]
    best = np.zeros(pairs, np.int32)
    before = np.zeros((pairs, rows + 1), np.int32)   # diagonal d - 2, by row
    last = np.zeros((pairs, rows + 1), np.int32)     # diagonal d - 1
    valid = np.arange(rows) < a_len[:, None]
    for d in range(rows + cols - 1):
        lo, hi = max(0, d - cols + 1), min(rows, d + 1)
        i = np.arange(lo, hi)
        x, y = a[:, lo:hi], b[:, d - i]
        score = np.where((x == y) & (x != 0), MATCH, MISMATCH)
        cell = np.maximum(before[:, lo:hi] + score,
                          np.maximum(last[:, lo:hi], last[:, lo + 1:hi + 1]) + GAP)
        cell = np.where(valid[:, lo:hi], np.maximum(cell, 0), 0)
        now = np.zeros_like(last)
        now[:, lo + 1:hi + 1] = cell
        np.maximum(best, cell.max(axis=1), out=best)
        before, last = last, now
    return best


def _windows(item: np.ndarray, shift: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
    """(item, start, stop, hits): each hit's window reaches as far around its diagonal as an
    edited copy may; windows of one item that overlap are one, so a text's windows of an
    item have no more words than the text and their ends."""
    order = np.lexsort((shift, item))
    item, shift = item[order], shift[order]
    reach = lengths[item] + 2 * (lengths[item] // 4 + 4)
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > reach[1:])
    first = np.flatnonzero(new)
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(item)]):
        length = int(lengths[item[i]])
        pad = length // 4 + 4
        yield int(item[i]), int(shift[i]) - pad, int(shift[j - 1]) + length + pad, j - i


def _align(block: Block, found: list[tuple]) -> list[float]:
    """Scores, as shares of a perfect copy's, of (doc words, item, start, stop)."""
    a_len = np.array([len(block.tokens[f[1]]) for f in found])
    a = np.zeros((len(found), a_len.max()), np.uint64)
    b = np.zeros((len(found), max(len(f[0][max(0, f[2]):f[3]]) for f in found)), np.uint64)
    for k, (doc, item, start, stop) in enumerate(found):
        a[k, :a_len[k]] = block.tokens[item]
        window = doc[max(0, start):stop]
        b[k, :len(window)] = window
    return (local_scores(a, a_len, b) / (MATCH * a_len)).tolist()


def _hits(block: Block, finder: _Finder, sizes: set, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, diagonal) of every seed in a text."""
    items, shifts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    for size in sizes:
        at, index = finder.find(ngram_hashes(doc, size))
        if len(at):
            repeat = finder.last[index] - index
            entry = np.repeat(index - np.concatenate([[0], np.cumsum(repeat)[:-1]]), repeat) + np.arange(repeat.sum())
            items.append(block.item[entry])
            shifts.append(np.repeat(at, repeat) - block.at[entry])
    return np.concatenate(items), np.concatenate(shifts)


def _matches(block: Block, finder: _Finder, n: int, texts: Iterator[np.ndarray]) -> Iterator[tuple]:
    """(row, item, score, start, hits) of every window, aligned in batches of bounded size."""
    lengths = np.array([len(t) for t in block.tokens])
    sizes = {n, *(len(t) for t in block.tokens if 0 < len(t) < n)}
    found: list[tuple] = []
    where: list[tuple] = []
    most = 0  # words of the largest item and window at hand

    def flush() -> Iterator[tuple]:
        for (row, item, start, hits), score in zip(where, _align(block, found) if found else []):
            yield row, item, score, start, hits
        found.clear()
        where.clear()

    for row, doc in enumerate(texts):
        item_of, shift = _hits(block, finder, sizes, doc)
        if not len(item_of):
            continue
        for item, start, stop, hits in _windows(item_of, shift, lengths):
            words = int(lengths[item]) + min(len(doc), stop) - max(0, start)
            if found and max(most, words) * (len(found) + 1) > ALIGNED_WORDS:
                yield from flush()
                most = 0
            most = max(most, words)
            found.append((doc, item, start, stop))
            where.append((row, item, max(0, start), hits))
    yield from flush()


def _document_words(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    for text in batch.column(column):
        yield text_words(text.as_py())


def _count(table, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.unique(table.value.grams)
        sizes = {n, *(len(t) for t in table.value.tokens if 0 < len(t) < n)}
        finder = _Finder(grams)
        counts = np.zeros(len(grams), np.int64)
        rows = 0
        for batch in batches:
            for doc in _document_words(batch, 0):
                rows += 1
                for size in sizes:
                    counts[np.unique(finder.find(ngram_hashes(doc, size))[1])] += 1
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *grams[hit].view(np.int64).tolist()], pa.int64()),
             pa.array([rows, *counts[hit].tolist()], pa.int64())], ["gram", "n"])

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    items, size = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy(
            "item_id", "text").toLocalIterator():
        items.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 4 + 1
        if size >= block_words:
            yield items
            items, size = [], 0
    if items:
        yield items


def _seed_blocks(docs: DataFrame, benchmark: DataFrame, n: int, block_words: int) -> list:
    spark = docs.sparkSession
    ship_package(spark)
    out = []
    for items in _blocks(benchmark, block_words):
        block = make_block(items, n)
        if not len(block.grams):
            continue
        counts = (docs.select("text").mapInArrow(_count(spark.sparkContext.broadcast(block), n),
                                                 "gram long, n long")
                  .groupBy("gram").agg(F.sum("n").alias("n")).toArrow())
        df = dict(zip(counts["gram"].to_pylist(), counts["n"].to_pylist()))
        total = df.pop(None, 0) or 0
        df = {g % 2**64: c for g, c in df.items()}
        out.append(spark.sparkContext.broadcast(seeds_of(block, df, total)))
    return out


MATCHES = "doc_id long, item_id long, score double, n_hits int, start_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, n: int = N,
                 min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The pairs of ``docs`` (doc_id, text) and ``benchmark`` (item_id, text) where the document
    holds a copy, edited copy or paraphrase of the item.

    One row per row of ``docs`` and item: doc_id, item_id, score (best local alignment over a
    perfect copy's, at least ``min_score``), n_hits (seed hits in that window), start_word
    (of the window). Words are lower-case runs of letters, digits and underscores. An
    item shorter than ``n`` words is one n-gram; empty or null items and texts match nothing.
    Repeated rows report once each, a null doc_id stays null, other columns are ignored;
    an empty table on either side gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    need_columns(benchmark, "item_id", "text")
    parts = []
    for table in _seed_blocks(docs, benchmark, n, block_words):
        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            block = table.value
            finder = _Finder(block.grams)
            for batch in small(batches, 256):
                best: dict = {}
                for row, item, score, start, hits in _matches(
                        block, finder, n, _document_words(batch, 1)):
                    if score >= min_score and score > best.get((row, item), (0.0,))[0]:
                        best[row, item] = (score, hits, start)
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[row] for row, _ in best], pa.int64()),
                     pa.array([block.ids[item] for _, item in best], pa.int64()),
                     pa.array([v[0] for v in best.values()], pa.float64()),
                     pa.array([v[1] for v in best.values()], pa.int32()),
                     pa.array([v[2] for v in best.values()], pa.int32())],
                    ["doc_id", "item_id", "score", "n_hits", "start_word"])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, MATCHES))
    if not parts:
        return docs.sparkSession.createDataFrame([], MATCHES)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = N, min_score: float = MIN_SCORE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that match no item; columns as they are."""
    need_columns(docs, "doc_id", "text")
    need_columns(benchmark, "item_id", "text")
    text_at = docs.columns.index("text")
    out = docs
    for table in _seed_blocks(docs, benchmark, n, block_words):
        def run(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            finder = _Finder(table.value.grams)
            for batch in small(batches, 256):
                dirty = {m[0] for m in _matches(table.value, finder, n,
                                                _document_words(batch, text_at))
                         if m[2] >= min_score}
                yield batch.filter(pa.array([i not in dirty for i in range(batch.num_rows)],
                                            pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out
