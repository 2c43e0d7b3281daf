"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the frequent pre-tokens and their numbers of
ids, broadcast to every worker; tier two a bounded cache in each Python worker that
encodes what the table lacks. Pre-tokens are never shuffled: the frequent ones are those of
a bounded sample of documents, counted in one task. The table only decides speed; the counts are
exact with any table, also an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linelift.llm.common import need_columns, ship_package
from linelift.llm.pretokens import CACHED_BYTES, Counts, byte_bpe_chunks, worker_cache

TABLE_ENTRIES = 32_768
"""Entries of the broadcast table, of at most 64 bytes each: 2 MB of keys at most."""
SAMPLE_DOCS = 2_048
"""Documents in which the frequent pre-tokens are counted: those whose id has the smallest hash."""
COUNTED_ENTRIES = 400_000
"""Distinct pre-tokens that are counted at a time; the rarer half goes then."""


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for text in batch.column(column).cast(pa.large_binary()):
        yield text.as_py() or b""


def _frequent(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for data in _texts(batch, 0):
                seen.update(byte_bpe_chunks(data))
                if len(seen) > COUNTED_ENTRIES:
                    seen = Counter(dict(seen.most_common(COUNTED_ENTRIES // 2)))
        top = [k for k, n in seen.most_common() if n > 1 and len(k) <= CACHED_BYTES][:entries]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.binary())], ["key"])

    return run


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int = TABLE_ENTRIES,
                     sample_docs: int = SAMPLE_DOCS) -> dict:
    """The table: key of a frequent pre-token -> its number of ids.

    Frequent in ``sample_docs`` documents at most, chosen by a hash of their ids; their texts go
    to one task, which sends ``entries`` keys of at most CACHED_BYTES to the driver.
    """
    from tokenizers import Tokenizer

    order = F.xxhash64("doc_id")
    chosen = (docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
              .orderBy(order, "doc_id").limit(sample_docs))
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample_docs rows
              .groupBy("doc_id").agg(F.max("text").alias("text")).select("text"))
    top = sample.coalesce(1).mapInArrow(_frequent(entries), "key binary").collect()
    counts = Counts(Tokenizer.from_file(tokenizer))
    return {bytes(r["key"]): counts[bytes(r["key"])] for r in top}


def token_counts(docs: DataFrame, *, tokenizer: str, max_tokens: int = 1024,
                 table_entries: int = TABLE_ENTRIES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Tokens of every whole text of ``docs`` (doc_id, text).

    One row per input row: doc_id, n_bytes (of the UTF-8 text), n_tokens, over_limit
    (n_tokens > ``max_tokens``). ``tokenizer``: a byte-level vocabulary file, present on
    every worker; no begin, end or other ids are added, and a special string inside a
    text is what the library makes of it by default. ``table_entries`` and ``sample_docs`` (see
    ``frequent_lengths``) bound the broadcast table and change speed alone.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids stay, repeated rows stay,
    other columns are ignored; an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    ship_package(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(
        frequent_lengths(docs, tokenizer, table_entries, sample_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = worker_cache(Counts, tokenizer, table.value).__getitem__
        for batch in batches:
            n_bytes, n_tokens = [], []
            for data in _texts(batch, 1):
                n_bytes.append(len(data))
                n_tokens.append(sum(map(size, byte_bpe_chunks(data))) if data else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()),
                 pa.array(n_tokens, pa.int64()),
                 pa.array([n > max_tokens for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
