"""Exact shortcuts for public byte-pair vocabularies.

Both vocabularies split a text before any merge, and never across the places
where the functions below cut it. A chunk between two cuts therefore has the same
ids alone as inside its text, so the ids of a chunk can be kept in a cache.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_BYTES = 64
"""Longer chunks are encoded each time and not kept."""
CACHE_ENTRIES = 300_000
"""Entries of each of the two generations of a worker's cache, so its memory is bounded."""

# Any of these means that white space may touch white space, or that the text has
# characters that some libraries count as white space and others don't.
_ODD = (b"  ", b" \n", b"\n ", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e",
        b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80",
        b"\xe2\x81", b"\xe3\x80\x80", b"\xef\xbb\xbf")
_CUT = re.compile("(?<=[^\\s᠎​‌‍⁠﻿])(?=[ \t\n\r\x0b\x0c])")

# A run of letters and the marks after it are pre-tokens of their own (contractions start
# with an apostrophe, which is left out).
_WORD_MARKS = re.compile(rb"([A-Za-z\x80-\xff]+)([!\"#$%&()*+,./:;=?@|~-]+)")


# Letters whose normal form is themselves and whose lower case is one letter each, whatever
# stands beside them: Latin without U+0130, which becomes a letter and a mark.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _byte_letters() -> dict[int, int]:
    """Byte -> the character that a byte-level vocabulary writes for it: itself if it is printable,
    else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return dict(zip(printable, printable)) | {b: 256 + i for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


def word_and_marks(chunk: bytes) -> tuple[bytes, bytes] | None:
    """The letters and the marks of a chunk that is just that."""
    m = _WORD_MARKS.fullmatch(chunk)
    if m and (m[1].isascii() or m[1].decode().isalpha()):
        return m[1], m[2]
    return None


def stays_letters(word: bytes) -> bool:
    """Whether composing and lower-casing the letters leaves nothing but letters. A combining
    mark that they leave at the end would join the marks that follow."""
    return word.isascii() or unicodedata.normalize("NFC", word.decode()).lower().isalpha()


def byte_bpe_chunks(data: bytes) -> list[bytes]:
    """Chunks of a text for the byte-level vocabulary (its words take one space before them).

    A cut lies before white space that follows anything else. Chunks are keyed:
    one that starts with a newline or carriage return marker stands for itself, any
    other one for a space and itself; the first chunk is keyed by a leading ``\\r``.
    """
    if any(odd in data for odd in _ODD):
        parts = [p.encode() for p in _CUT.split(data.decode())]
        return [b"\r" + p for p in parts if p]
    parts = data.replace(b"\n", b" \n").split(b" ")
    if parts[0][:1] != b"\n":
        parts[0] = b"\r" + parts[0]
    return parts


def byte_bpe_text(key: bytes) -> str:
    """The text that a key of ``byte_bpe_chunks`` stands for."""
    if key[:1] == b"\r":
        return key[1:].decode()
    return key.decode() if key[:1] == b"\n" else " " + key.decode()


class _Cache(dict):
    """Two generations: when the young one is full it becomes the old one, and
    entries of the old one that are read again move to the young one."""

    def __init__(self, tokenizer, frequent=()):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.old = tokenizer, frequent, {}
        self.model = tokenizer.model

    def keep(self, key: bytes, value):
        if len(key) <= CACHED_BYTES:
            if len(self) > CACHE_ENTRIES + len(self.frequent):
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[key] = value
        return value


class Counts(_Cache):
    """Key of ``byte_bpe_chunks`` -> number of ids; misses are encoded and kept."""

    def __missing__(self, key: bytes) -> int:
        n = self.old.get(key)
        if n is None:
            if parts := word_and_marks(key):
                n = self[parts[0]] + self[b"\r" + parts[1]]
            elif key.isalpha():  # a pre-token; the vocabulary writes its space as U+0120
                n = len(self.model.tokenize("\u0120" + key.decode()))
            else:
                n = len(self.tokenizer.encode(byte_bpe_text(key), add_special_tokens=False).ids)
        return self.keep(key, n)


class Ids(_Cache):
    """Word between ASCII white space -> its ids as little-endian unsigned 32-bit numbers.

    For the vocabulary that drops white space: no pre-token holds any, and neither
    its normal form nor its lower case looks across white space.
    """

    def __missing__(self, word: bytes) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            if word.isalpha() and word.islower():  # ASCII letters, a pre-token as they stand
                packed = self._tokenize(word.decode())
            elif _LATIN.fullmatch(text := word.decode()):  # so is their lower case, byte by byte
                packed = self._tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_LETTERS))
            elif (parts := word_and_marks(word)) and stays_letters(parts[0]):
                packed = self[parts[0]] + self[parts[1]]
            else:
                packed = _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.keep(word, packed)

    def _tokenize(self, pre_token: str) -> bytes:
        return _packed([t.id for t in self.model.tokenize(pre_token)])

    def encode(self, data: bytes) -> bytes:
        """The packed ids of a text."""
        return b"".join(self.encode_batch(pa.array([data], pa.binary()).cast(pa.string())))

    def encode_batch(self, texts: pa.Array) -> Iterator[memoryview]:
        """The packed ids of each text (null: none). A word is looked up once for all of them."""
        texts = pc.fill_null(texts, "")
        # The vocabulary lower-cases after composing; doing it before is the same unless
        # a mark (U+0300 to U+036F) composes with a letter or a special string appears.
        as_is = [b"\xcc" in data or b"\xcd" in data or b"<|" in data for data in _objects(texts)]
        texts = pc.if_else(pa.array(as_is, pa.bool_()), texts, pc.ascii_lower(texts))
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        known = pa.array(list(map(self.__getitem__, _objects(words.dictionary))), pa.large_binary())
        packed = memoryview(known.take(words.indices).buffers()[2] or b"").cast("B")
        sizes = pc.binary_length(known).to_numpy()[words.indices.to_numpy()]
        before = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        at = 0
        for end in before[np.cumsum(pc.list_value_length(lists).to_numpy())].tolist():
            yield packed[at:end]
            at = end


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _objects(texts: pa.Array) -> np.ndarray:
    return texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)


_caches: dict = {}


def worker_cache(kind: type, path: str, frequent=()):
    """One tokenizer and cache per Python worker and vocabulary file."""
    from tokenizers import Tokenizer

    key = (kind, path, id(frequent))
    if key not in _caches:
        _caches.clear()
        _caches[key] = kind(Tokenizer.from_file(path), frequent)
    return _caches[key]
