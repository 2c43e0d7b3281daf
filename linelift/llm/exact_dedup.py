"""Exact deduplication by Grace hashing.

Texts are equal when they are identical without the characters
``[\\x20\\x09-\\x0D]``. The stages:

1. One pass gives every row a number and the SHA-256 of its normal form; of each batch of
   rows it marks the best row of each distinct content and counts the copies. The
   rows go to a table in the shared folder.
2. The marked rows alone (at most one per batch and content, so a hot content is
   pre-aggregated) are dealt by hash. Each task runs a Grace hash aggregation:
   records stream into an open-addressing table that compares complete content; contents
   that no longer fit go to spill files by the next bits of their hash, which are
   then worked through in turn, recursively.
3. The classes join back to all rows by digest. Should two contents share a
   digest, the aggregation finds it and the job fails rather than merge them.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelift.llm.common import materialize, need_columns, ship_package

SPACE = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 64 << 20
"""Content that one open-addressing table may hold before the rest is spilled."""
FAN_OUT = 16
DIGEST = "_dedup_sha256"
MARKED = "_dedup_marked"
CODE_POINTS = "_dedup_code_points"
COPIES = "_dedup_copies"
ROW = "_dedup_row"
KEEP_ID, SIZE, KEEP_ROW = "_dedup_keep_id", "_dedup_size", "_dedup_keep_row"


class ContentTable:
    """Open addressing with linear probing; slots hold (hash, content, state).

    With ``strict``, different contents of one hash are an error.
    """

    def __init__(self, strict: bool = False):
        self.strict = strict
        self.slots: list = [None] * 64
        self.used = 0
        self.content_bytes = 0

    def slot(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) is not None:
            if entry[0] == h:
                if entry[1] == content:
                    return at
                if self.strict:
                    raise ValueError(f"two different contents share the hash {h:x}")
            at = (at + 1) & mask
        return at

    def add(self, at: int, h: int, content: bytes, state) -> None:
        self.slots[at] = [h, content, state]
        self.used += 1
        self.content_bytes += len(content)
        if 3 * self.used > 2 * len(self.slots):
            entries = [e for e in self.slots if e is not None]
            self.slots = [None] * (2 * len(self.slots))
            for e in entries:
                self.slots[self.slot(e[0], e[1])] = e


def grace_classes(records: Iterator[tuple], merge, *, bucket_bytes: int = BUCKET_BYTES,
                  fan_out: int = FAN_OUT, folder: str | None = None,
                  strict: bool = False) -> Iterator[tuple]:
    """Aggregate ``(hash, content, state)`` records by complete content.

    Yields ``(hash, content, state)`` once per content, states combined by ``merge``. Holds
    at most ``bucket_bytes`` of content plus one record; contents beyond that are
    written to ``fan_out`` spill files by their hash's low digits and aggregated
    file by file, on the next digits each time. Copies of a held content never spill, so a
    hot content needs no recursion; once the digits are used up the content's own
    SHA-512 takes over, so equal hashes cannot stop the recursion.
    """
    with tempfile.TemporaryDirectory(dir=folder) as scratch:
        pending: list = [(records, 0)]
        names = 0
        while pending:
            source, level = pending.pop()
            table, files = ContentTable(strict), {}
            for h, content, state in source:
                at = table.slot(h, content)
                if (entry := table.slots[at]) is not None:
                    entry[2] = merge(entry[2], state)
                elif not table.used or table.content_bytes + len(content) <= bucket_bytes:
                    table.add(at, h, content, state)
                else:
                    digit = _digit(h, content, level, fan_out)
                    if digit not in files:
                        names += 1
                        path = os.path.join(scratch, str(names))
                        files[digit] = (path, open(path, "wb"))
                    pickle.dump((h, content, state), files[digit][1])
            for path, out in files.values():
                out.close()
                pending.append((_read_spill(path), level + 1))
            for entry in table.slots:
                if entry is not None:
                    yield tuple(entry)


def _digit(h: int, content: bytes, level: int, fan_out: int) -> int:
    if level < 8:
        return (h // fan_out ** level) % fan_out
    deep = hashlib.sha512(content + level.to_bytes(4, "little")).digest()
    return int.from_bytes(deep[:8], "little") % fan_out


def _read_spill(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                break
    os.remove(path)


def _digests(text_at: int, doc_at: int):
    """Adds row, digest, code points and the batch's marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(text_at).cast(pa.large_binary())
            ids = batch.column(doc_at).to_pylist()
            digests, lengths = [], []
            best: dict[bytes, int] = {}
            copies: dict[bytes, int] = {}
            for i, text in enumerate(texts):
                data = text.as_py() or b""
                digest = hashlib.sha256(data.translate(None, SPACE)).digest()
                digests.append(digest)
                lengths.append(len(data.decode()))
                copies[digest] = copies.get(digest, 0) + 1
                j = best.get(digest)
                if j is None or _rank(lengths[i], ids[i]) < _rank(lengths[j], ids[j]):
                    best[digest] = i
            marked = set(best.values())
            rows = range(row, row + len(digests))
            row += len(digests)
            extra = [pa.array(rows, pa.int64()), pa.array([d.hex() for d in digests]),
                     pa.array(lengths, pa.int64()),
                     pa.array([i in marked for i in range(len(digests))]),
                     pa.array([copies[d] if i in marked else 0 for i, d in enumerate(digests)],
                              pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra],
                [*batch.schema.names, ROW, DIGEST, CODE_POINTS, MARKED, COPIES])

    return run


def _rank(length: int, doc_id: int | None) -> tuple:
    """Smaller is better: most code points, then smallest doc_id (a null one last)."""
    return (-length, doc_id is None, doc_id or 0)


def _merge(a: tuple, b: tuple) -> tuple:
    """States are (copies, code points, doc_id, row)."""
    best = min(a, b, key=lambda s: (*_rank(s[1], s[2]), s[3]))
    return (a[0] + b[0], *best[1:])


def _classes(bucket_bytes: int):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for text, digest, *state in zip(batch.column(0).cast(pa.large_binary()), *columns):
                yield int(digest, 16), (text.as_py() or b"").translate(None, SPACE), tuple(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(4)]
        for h, _, (count, _, doc_id, row) in grace_classes(
                records(batches), _merge, bucket_bytes=bucket_bytes, strict=True):
            for column, value in zip(out, (f"{h:064x}", doc_id, count, row)):
                column.append(value)
            if len(out[0]) >= 10_000:
                yield _class_batch(out)
                out = [[] for _ in range(4)]
        yield _class_batch(out)

    return run


def _class_batch(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.string()), *[pa.array(c, pa.int64()) for c in out[1:]]],
        [DIGEST, KEEP_ID, SIZE, KEEP_ROW])


def _groups(docs: DataFrame, bucket_bytes: int) -> DataFrame:
    """``docs`` with ROW, DIGEST and its group's KEEP_ID, SIZE and KEEP_ROW."""
    need_columns(docs, "doc_id", "text")
    ship_package(docs.sparkSession)
    schema = T.StructType(docs.schema.fields + [
        T.StructField(ROW, T.LongType()), T.StructField(DIGEST, T.StringType()),
        T.StructField(CODE_POINTS, T.LongType()), T.StructField(MARKED, T.BooleanType()),
        T.StructField(COPIES, T.LongType())])
    rows = materialize(docs.mapInArrow(
        _digests(docs.columns.index("text"), docs.columns.index("doc_id")), schema), "dedup")
    classes = (rows.where(MARKED)
               .select("text", DIGEST, COPIES, CODE_POINTS, "doc_id", ROW)
               .repartition(DIGEST)
               .mapInArrow(_classes(bucket_bytes),
                           f"{DIGEST} string, {KEEP_ID} long, {SIZE} long, {KEEP_ROW} long"))
    classes = materialize(classes, "dedup-classes")
    return rows.drop(MARKED, CODE_POINTS, COPIES).join(classes, DIGEST)


def exact_dedup(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Groups of equal texts: every row of ``docs`` (doc_id, text, ...) with its group.

    Adds keep_id (doc_id of the row that stays), group_size, kept and text_sha256 (lowercase
    hex of the normal form in UTF-8); columns of these names in the input are
    replaced. The row with the most code points in its original text stays, then the
    smallest doc_id (null last), then the first row as read: exactly one row of a
    group is kept, also among repeated rows.

    A null text counts as empty, and all texts that are empty or only white space
    form one group. An empty table gives no rows. Other columns pass through.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    return _groups(docs, bucket_bytes).select(
        *docs.columns, F.col(KEEP_ID).alias("keep_id"), F.col(SIZE).alias("group_size"),
        (F.col(ROW) == F.col(KEEP_ROW)).alias("kept"), F.col(DIGEST).alias("text_sha256"))


def keep_one(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts; columns as they are."""
    return _groups(docs, bucket_bytes).where(F.col(ROW) == F.col(KEEP_ROW)).select(*docs.columns)
