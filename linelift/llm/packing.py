"""Packing: first-fit decreasing into fixed-length sequences, per randomised group.

A map step encodes each text, adds the end id and cuts the document every
``length`` ids, so only its last piece is shorter. Pieces (ids replaced by their
checksum) go to randomised groups of about ``docs_per_group`` documents; each
group is packed alone, so no task and no state grows with the corpus. Inside a group
the pieces are sorted by length, longest first, and each goes to the first bin
that still holds it; a tournament tree over the bins' free room finds that bin in
log2(bins) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from linelift.llm.common import need_columns, ship_package, small
from linelift.llm.pretokens import Ids, worker_cache

END_ID = 1
PIECES_PER_SLICE = 1024
"""A document of more pieces is dealt to several groups, in slices of this many."""
ROWS_AT_ONCE = 512
"""Rows whose words are looked up together, so that a worker holds few of them as objects."""

PIECES = ("pack_group long, doc_id long, start long, length long, ids_crc32 long, "
          "doc_tokens long")
RESULT = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Tournament:
    """Max tree over the free room of bins 0, 1, ...; all bins start empty."""

    def __init__(self, bins: int, room: int):
        self.base = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.base)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; the bin's number."""
        tree, at = self.tree, 1
        if tree[1] < size:
            raise ValueError("no bin has room")
        while at < self.base:
            at *= 2
            if tree[at] < size:
                at += 1
        found = at - self.base
        tree[at] -= size
        while at > 1:
            at //= 2
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size (none above ``room``); ``sizes`` must not grow."""
    tree = Tournament(len(sizes), room)
    used: dict[int, int] = {}
    bins, offsets = [], []
    for size in sizes:
        b = tree.place(size)
        bins.append(b)
        offsets.append(used.get(b, 0))
        used[b] = offsets[-1] + size
    return bins, offsets


def _pieces(tokenizer: str, length: int, groups: int, seed: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = worker_cache(Ids, tokenizer)
        part, row = TaskContext.get().partitionId(), 0
        for batch in small(batches, ROWS_AT_ONCE):
            out = [[] for _ in range(6)]
            for doc_id, text_ids in zip(batch.column(0).to_pylist(),
                                        ids.encode_batch(batch.column(1))):
                packed = b"".join((text_ids, end))
                total = len(packed) // 4
                row += 1
                for start in range(0, total, length):
                    if start % (length * PIECES_PER_SLICE) == 0:
                        # salted by the row, so repeated rows and null ids spread as well
                        key = f"{seed} {doc_id} {start} {part} {row}".encode()
                        group = zlib.crc32(key) % groups
                    piece = packed[4 * start:4 * (start + length)]
                    for column, value in zip(out, (group, doc_id, start, len(piece) // 4,
                                                   zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             PIECE_NAMES)
            pa.default_memory_pool().release_unused()

    return run


PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _pack_group(length: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "ids_crc32"],
                                    ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), length)
        pieces["sequence_id"] = (pieces["pack_group"].to_numpy() << 32) + np.array(bins, np.int64)
        pieces["offset"] = np.array(offsets, np.int64)
        return pieces.drop(columns="pack_group")

    return run


def pack(docs: DataFrame, *, tokenizer: str, length: int = 2048, docs_per_group: int = 8192,
         seed: int = 17) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``length`` ids.

    One row per piece: doc_id, start (ids of its document before it), length,
    ids_crc32 (unsigned, of its little-endian unsigned 32-bit ids), doc_tokens (the
    document's ids with the end id), sequence_id, offset (within the sequence).
    ``tokenizer``: a vocabulary file that drops white space, present on every worker.

    A null or empty text is its end id alone. Repeated rows are packed once each; a
    null doc_id stays null. Other columns are ignored. An empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    groups = max(1, -(-docs.count() // docs_per_group))
    pieces = docs.mapInArrow(_pieces(tokenizer, length, groups, seed), PIECES)
    return pieces.groupBy("pack_group").applyInPandas(_pack_group(length), RESULT)
