"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per worker.

A text is cut into words by the vocabulary's pattern. The words that a worker has not met yet
become token-position rows (word, position, token) of its in-memory database. A recursive query
joins adjacent rows with the merge table and contracts each word's leftmost pair of minimum
rank, round by round, until no pair of any word is in the table. Decoding joins ids with the
vocabulary and aggregates their bytes in order of position.

- The merge table holds every way to cut a token in two tokens, as the library ranks a pair by
  the bytes that it makes, however these were put together.
- A word that is a token is that token, without merges, as in the library.
- A long word is first cut between bytes that stand side by side in no token: no merge can
  reach across. What stays long is contracted by a second query that takes all
  occurrences of the minimum-rank pair in a round. That is the same as one after the other
  unless the new token is part of a token of lower rank; then it takes one (``alone``).

Words are kept in a bounded cache per worker; texts and ids are worked off in bounded blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linelift.llm.common import need_columns, ship_package

CACHED_CHARS = 64
"""Longer words are encoded each time and not kept."""
CACHE_ENTRIES = 600_000
"""Words in each of the two generations of a worker's cache."""
BLOCK_WORDS = 500_000
"""Words that are looked up at a time."""
QUERY_BYTES = 1 << 17
"""Bytes of short words that one query contracts."""
LONG_BYTES = 256
"""Longer words (after the cuts) go to the query for long ones, one at a time."""
BLOCK_IDS = 1 << 20
"""Ids that one query decodes."""
DATABASE_MEMORY = "400MB"

# One pair of each word in a round. Positions count through all words. A row knows the position
# (next) and the token (follower) of the row after it; ``step`` makes every row of a live word
# new, so that it is read again.
_SHORT = """
WITH RECURSIVE tokens(pos, word, id, next, follower, step) USING KEY (pos) AS (
  SELECT pos, word, id, next, follower, 0 FROM bytes_of_words
  UNION
  (WITH live AS (SELECT pos, word, id, next, follower, step FROM tokens WHERE id IS NOT NULL),
   least AS (
     SELECT word, min(new::BIGINT << 32 | pos) AS pair
     FROM live JOIN merges ON l = id AND r = follower GROUP BY word),
   chosen AS (
     SELECT p.word, (pair >> 32)::INTEGER AS new, a.pos AS at, a.next AS gone, b.next, b.follower
     FROM least p JOIN live a ON a.pos = (pair & 4294967295)::INTEGER JOIN live b ON b.pos = a.next)
   SELECT t.pos, t.word, CASE WHEN t.pos = c.at THEN c.new WHEN t.pos <> c.gone THEN t.id END,
          CASE WHEN t.pos = c.at THEN c.next ELSE t.next END,
          CASE WHEN t.pos = c.at THEN c.follower WHEN t.next = c.at THEN c.new ELSE t.follower END,
          t.step + 1
   FROM live t JOIN chosen c ON c.word = t.word))
SELECT word, id FROM tokens WHERE id IS NOT NULL ORDER BY pos
"""

# All occurrences of the pair of minimum rank; of overlapping ones the first, third, ... of a run.
_LONG = """
WITH RECURSIVE tokens(pos, id, step) USING KEY (pos) AS (
  SELECT pos, id, 0 FROM bytes_of_words
  UNION
  (WITH pairs AS (
     SELECT pos, id, step, k, new, alone, min(new) OVER () AS best
     FROM (SELECT pos, id, step, lead(id) OVER w AS follower, row_number() OVER w AS k
           FROM tokens WHERE id IS NOT NULL WINDOW w AS (ORDER BY pos))
     LEFT JOIN merges ON l = id AND r = follower),
   hits AS (
     SELECT pos, k, best, alone, row_number() OVER (ORDER BY k) AS nth FROM pairs WHERE new = best),
   taken AS (
     SELECT k, best FROM (SELECT k, best, alone, nth, row_number() OVER (PARTITION BY k - nth ORDER BY k) AS place
                          FROM hits)
     WHERE place % 2 = 1 AND (NOT alone OR nth = 1))
   SELECT p.pos, CASE WHEN t.k IS NOT NULL THEN t.best WHEN g.k IS NULL THEN p.id END, p.step + 1
   FROM pairs p LEFT JOIN taken t ON t.k = p.k LEFT JOIN taken g ON g.k = p.k - 1
   WHERE p.best IS NOT NULL))
SELECT 0 AS word, id FROM tokens WHERE id IS NOT NULL ORDER BY pos
"""

_DECODE = """
SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM ids JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}


def library_classes() -> dict[int, str]:
    """Characters whose class the library's tables and this regex module's see differently ->
    a character of the class that the library puts them in."""
    import regex
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out: dict[int, str] = {}
    for cls, member in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", "\t")):
        probe = tiktoken.Encoding("probe", pat_str=cls, special_tokens={},
                                  mergeable_ranks={bytes([i]): i for i in range(256)})
        theirs = set(bytes(probe.encode_ordinary(every)).decode())
        ours = set(regex.findall(cls, every))
        out |= {ord(c): member for c in theirs - ours}
        for c in ours - theirs:
            out.setdefault(ord(c), "")
    return out


def ascii_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of ASCII characters alone."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        inside = part == "[" or inside and part != "]"
        members = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}.get(part)
        out.append(part if members is None else members if inside else f"[{members}]")
    return re.compile("".join(out), re.ASCII)


class Words:
    """Cuts texts into words as the library does with the same pattern."""

    def __init__(self, pattern: str):
        import regex

        self.pattern, self.ascii = regex.compile(pattern), ascii_pattern(pattern)
        self.classes = library_classes()
        self.odd = frozenset(map(chr, self.classes))

    def __call__(self, text: str) -> Iterator[str]:
        """The words of a text, one after the other where it is long."""
        pattern = self.ascii if text.isascii() else self.pattern
        if pattern is self.ascii or self.odd.isdisjoint(text):
            if len(text) <= BLOCK_WORDS:
                return iter(pattern.findall(text))
            return (m[0] for m in pattern.finditer(text))
        same = text.translate(self.classes)  # as many characters, so the spans fit
        return (text[m.start():m.end()] for m in self.pattern.finditer(same))


class Database:
    """A vocabulary in an in-memory database of this process."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.ranks = ranks
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DATABASE_MEMORY})
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.known[list(ranks.values())] = True
        left, right, new = [], [], []
        self.touching = np.zeros(1 << 16, bool)
        for token, rank in ranks.items():
            self.touching[[a << 8 | b for a, b in zip(token, token[1:])]] = True
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    new.append(rank)
        parts, whole = np.array([left, right], np.int32), np.array(new, np.int32)
        early = np.unique(parts[parts > whole])  # parts of a token of lower rank
        self._table("merges", l=parts[0], r=parts[1], new=whole, alone=np.isin(whole, early))
        self._table("vocabulary", id=np.array(list(ranks.values()), np.int32),
                    hex=pa.array([t.hex() for t in ranks]))

    def _table(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _run(self, name: str, table: pa.Table, query: str) -> pa.Table:
        self.con.register(name, table)
        try:
            return self.con.sql(query).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _cuts(self, word: bytes) -> list[bytes]:
        """The word's pieces between bytes that no token has side by side."""
        b = np.frombuffer(word, np.uint8).astype(np.int32)
        at = (np.flatnonzero(~self.touching[b[:-1] << 8 | b[1:]]) + 1).tolist()
        return [word[i:j] for i, j in zip([0, *at], [*at, len(word)])]

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of short words, or of a single long one."""
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        number = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        pos = np.arange(ends[-1], dtype=np.int32)
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        last = np.zeros(len(ids), bool)
        last[ends - 1] = True
        rows = pa.table({"word": number, "pos": pos, "id": ids, "next": pa.array(pos + 1, mask=last),
                         "follower": pa.array(np.append(ids[1:], ids[:1]), mask=last)})
        done = self._run("bytes_of_words", rows, _LONG if sizes[0] > LONG_BYTES else _SHORT)
        found = done["id"].to_numpy().astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(done["word"].to_numpy(), np.arange(len(words) + 1))).tolist()
        return [found[i:j] for i, j in zip(cuts, cuts[1:])]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as packed little-endian unsigned 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in words]
        held: list[tuple[list, int]] = []  # where each piece of the next query belongs
        pieces: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal held, pieces, size
            if pieces:
                for (parts, at), packed in zip(held, self._contract(pieces)):
                    parts[at] = packed
            held, pieces, size = [], [], 0

        for parts, word in zip(out, words):
            rank = self.ranks.get(word)
            if rank is not None:
                parts.append(rank.to_bytes(4, "little"))
                continue
            for piece in [word] if len(word) <= CACHED_CHARS else self._cuts(word):
                parts.append(b"")
                if len(piece) > LONG_BYTES:
                    parts[-1] = self._contract([piece])[0]
                    continue
                held.append((parts, len(parts) - 1))
                pieces.append(piece)
                size += len(piece)
                if size > QUERY_BYTES:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]

    def decode(self, docs: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids, in blocks of BLOCK_IDS rows."""
        out: list[list[bytes]] = [[] for _ in docs]
        rows: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal rows, size
            if size:
                ids = np.concatenate([part for _, part in rows])
                table = pa.table({
                    "doc": np.repeat(np.arange(len(rows), dtype=np.int32), [len(p) for _, p in rows]),
                    "pos": np.arange(len(ids), dtype=np.int32), "id": ids.astype(np.int32)})
                found = self._run("ids", table, _DECODE)
                for at, data in zip(found["doc"].to_pylist(), found["bytes"].to_pylist()):
                    out[rows[at][0]].append(data)
            rows, size = [], 0

        for doc, ids in enumerate(docs):
            known = (ids >= 0) & (ids < len(self.known))
            known[known] = self.known[ids[known]]
            if not known.all():
                raise ValueError(f"ids that the vocabulary lacks: {ids[~known][:5].tolist()}")
            for at in range(0, len(ids), BLOCK_IDS):
                part = ids[at:at + BLOCK_IDS]
                rows.append((doc, part))
                size += len(part)
                if size >= BLOCK_IDS:
                    flush()
        flush()
        return [b"".join(parts) for parts in out]


class Encoder:
    """Texts -> packed ids, with a cache of words in two generations."""

    def __init__(self, path: str, pattern: str):
        self.words = Words(pattern)
        self.database = Database(read_ranks(path))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _block(self, words: list[str]) -> Iterable[bytes]:
        missing = set(words).difference(self.young)
        known = {w: self.old[w] for w in missing if w in self.old}
        new = sorted(missing.difference(known), key=len)  # words of a query need alike many rounds
        self.young.update(known)
        self.young.update(zip(new, self.database.encode_words([w.encode() for w in new])))
        found = list(map(self.young.__getitem__, words))
        for word in new:
            if len(word) > CACHED_CHARS:
                del self.young[word]
        if len(self.young) > CACHE_ENTRIES:
            self.young, self.old = {}, self.young
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        out = [bytearray() for _ in texts]
        words: list[str] = []
        held: list[tuple[bytearray, int]] = []

        def flush() -> None:
            nonlocal words, held
            found = iter(self._block(words))
            for packed, n in held:
                packed += b"".join(islice(found, n))
            words, held = [], []

        for packed, text in zip(out, texts):
            found = self.words(text)
            while more := list(islice(found, BLOCK_WORDS)):
                words += more
                held.append((packed, len(more)))
                if len(words) >= BLOCK_WORDS:
                    flush()
        flush()
        return list(map(bytes, out))


_encoders: dict = {}


def worker_encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders.clear()
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    return [t.as_py() or "" for t in column.cast(pa.large_string())]


def _lists(packed: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(packed), "<i4"))


def encode(docs: DataFrame, *, ranks: str, pattern: str) -> DataFrame:
    """The ids of every whole text of ``docs`` (doc_id, text): (doc_id, ids array<int>).

    ``ranks``: a rank file, present on every worker; ``pattern``: what a word is, in the
    library's syntax with the classes \\p{L}, \\p{N} and \\s. There are no special tokens.

    One row per input row. A null text counts as empty and has no ids. Null ids and repeated
    rows stay; other columns are ignored; an empty table gives no rows.
    """
    need_columns(docs, "doc_id", "text")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), _lists(encoder.encode(_texts(batch.column(1))))],
                ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, *, ranks: str) -> DataFrame:
    """The bytes of every list of ids of ``encoded`` (doc_id, ids): (doc_id, data binary).

    A null list counts as empty; an id that the vocabulary lacks, or a null one, fails the job. One row per
    input row; other columns are ignored; an empty table gives no rows.
    """
    need_columns(encoded, "doc_id", "ids")
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        database = worker_encoder(ranks, "").database
        for batch in batches:
            ids = [np.array([-1 if i is None else i for i in ids.as_py() or []], np.int64)
                   for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(database.decode(ids), pa.binary())],
                ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, *, ranks: str, pattern: str) -> DataFrame:
    """Digests of ``encode`` and of ``decode`` of its ids, in one pass over the texts.

    (doc_id, n_tokens, ids_sha256, decoded_sha256): lower-case hex digests of the ids as
    little-endian unsigned 32-bit numbers, and of the bytes that the ids decode to. Odd rows are
    treated as ``encode`` does; the digests of an empty text are those of no bytes.
    """
    need_columns(docs, "doc_id", "text")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(ranks, pattern)
        for batch in batches:
            packed = encoder.encode(_texts(batch.column(1)))
            data = encoder.database.decode([np.frombuffer(p, "<u4") for p in packed])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()),
                 pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                 pa.array([hashlib.sha256(d).hexdigest() for d in data])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
