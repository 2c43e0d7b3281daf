"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random
import struct

import pytest
import tiktoken
from llm_helpers import EDGE_TEXTS, TOKENIZERS

from linelift.llm import bpe
from linelift.llm.queries import BPE_PATTERN, QUERIES

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=BPE_PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, BPE_PATTERN)


def pack(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def texts_of_all_kinds():
    rng = random.Random(4)
    out = [t or "" for t in EDGE_TEXTS]
    out += ["a" * 3000, "ab" * 900 + "c", "=" * 777, " " * 500 + "x", "\n" * 40 + "y", "the" * 400,
            "".join(chr(rng.randrange(65, 123)) for _ in range(3000)), "한국어" * 200, "don't we'll I'M 'sx",
            "".join(rng.choice("etaoin") for _ in range(700))]
    letters = [*"  \n\t'asdtlre0159.,!é한🙂ß", "\u0085", " ", "\x1c", " ", "՘", "౜", "\U00011de3"]
    out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x30000)]))
                    for _ in range(40)) for _ in range(500)]
    return out


def test_ids_are_the_librarys(encoder, library):
    texts = texts_of_all_kinds()
    for text, packed in zip(texts, encoder.encode(texts)):
        assert packed == pack(library.encode_ordinary(text)), text[:80]


def test_every_character_is_in_the_librarys_class(encoder, library):
    texts = ["".join(f"a{c}1" for c in map(chr, range(i, i + 256)) if not 0xD800 <= ord(c) < 0xE000)
             for i in range(0, 0x32000, 256)]
    for text, packed in zip(texts, encoder.encode(texts)):
        assert packed == pack(library.encode_ordinary(text)), hex(ord(text[1])) if text else ""


def test_small_caches_and_blocks_give_the_same(monkeypatch, library):
    for name, value in (("CACHE_ENTRIES", 7), ("BLOCK_WORDS", 5), ("QUERY_BYTES", 40), ("LONG_BYTES", 9),
                        ("BLOCK_IDS", 11), ("CACHED_CHARS", 6)):
        monkeypatch.setattr(bpe, name, value)
    small, rng = bpe.Encoder(RANKS, BPE_PATTERN), random.Random(5)
    texts = [" ".join(rng.choice(["strengthening", "aaaaaaaaaaaaaaaaaaaaa", "x", "Überraschung", "abcabcabcabcabc"])
                      for _ in range(rng.randrange(12))) for _ in range(40)]
    packed = small.encode(texts)
    assert packed == [pack(library.encode_ordinary(t)) for t in texts]
    ids = [list(struct.unpack(f"<{len(p) // 4}I", p)) for p in packed]
    import numpy as np

    assert small.database.decode([np.array(i, np.int64) for i in ids]) == [t.encode() for t in texts]


def test_odd_vocabulary_contracts_like_the_library():
    """Random vocabularies, where a longer token may rank before its parts."""
    rng = random.Random(6)
    for _ in range(25):
        tokens = [bytes([i]) for i in range(256)]
        more = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(30)}
        ranks = {t: i for i, t in enumerate(tokens + rng.sample(sorted(more), len(more)))}
        library = tiktoken.Encoding("odd", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        database = bpe.Database(ranks)
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(1, 600))) for _ in range(12)]
        assert database.encode_words(words) == [pack(library.encode_ordinary(w.decode())) for w in words]


def test_operators(spark, docs, library):
    rows = list(enumerate(EDGE_TEXTS)) + [(3, "one"), (3, "one"), (None, "no id")]
    given = docs(rows, "ids word pos data n_tokens")
    encoded = bpe.encode(given, ranks=RANKS, pattern=BPE_PATTERN)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(d, library.encode_ordinary(t or "")) for d, t in rows]
    assert sorted(map(tuple, encoded.collect()), key=order) == sorted(want, key=order)
    decoded = bpe.decode(encoded, ranks=RANKS)
    assert (sorted(((r[0], bytes(r[1])) for r in decoded.collect()), key=order)
            == sorted(((d, (t or "").encode()) for d, t in rows), key=order))
    digests = [(d, len(i), hashlib.sha256(pack(i)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
               for (d, t), (_, i) in zip(rows, want)]
    got = bpe.round_trip(given, ranks=RANKS, pattern=BPE_PATTERN)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(digests, key=order)
    assert bpe.round_trip(given.limit(0), ranks=RANKS, pattern=BPE_PATTERN).collect() == []


def test_unknown_ids_fail(spark):
    rows = spark.createDataFrame([(1, [5, 10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(rows, ranks=RANKS).collect()


def test_query(spark, library):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text = r["text"] or ""
        ids = library.encode_ordinary(text)
        want.append((r["doc_id"], len(ids), hashlib.sha256(pack(ids)).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op11_byte_bpe"](spark, SF).collect())) == sorted(want)
