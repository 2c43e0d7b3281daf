"""Ranked search against plain scoring of every document for every item."""

import random
import re
from collections import Counter

import pytest
from llm_helpers import EDGE_TEXTS, random_text

from linelift.llm import lexical_search
from linelift.llm.lexical_search import ranked_search, term_weight

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(d, Counter(split(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item_id, text in {(i, t) for i, t in items if t}:
        query, scored = Counter(split(text)), []
        for d, bag, n in bags:
            m = 100 - 75 + 75 * n * n_docs // total
            score = sum(q * term_weight(n_docs, df[t]) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m))
                        for t, q in query.items() if t in bag)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    docs = spark.createDataFrame([(*r, "x", "x") for r in docs],
                                 "doc_id long, text string, score string, item_id string").repartition(3)
    items = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    return sorted(map(tuple, ranked_search(docs, items, **options).collect()), key=repr)


@pytest.fixture
def tiny(monkeypatch):
    """Small segments, windows and blocks, so that every path is taken."""
    for name, value in (("SEGMENT_DOCS", 17), ("SEGMENT_WORDS", 600), ("WINDOW_DOCS", 5), ("SHORT_SHARE", 4),
                        ("BLOCK_BYTES", 400), ("SALTS", 3)):
        monkeypatch.setattr(lexical_search, name, value)


def corpus(seed, n=300):
    """Documents over words of very unequal frequency, many of them equal in score."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(1000 + i, "w3 w5 w50 w51") for i in range(25)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_are_exact(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_ranks_are_exact_in_pieces(spark):
    """Tasks see other constants only through their arguments, so the pieces are searched here."""
    import numpy as np

    docs, items = corpus(3, 400)
    want = brute(docs, items, 7)
    block = lexical_search.make_block(items)
    vocabulary = type("Given", (), {"value": block.vocabulary})
    import pyarrow as pa

    sizes = {}
    for name, value in (("SEGMENT_DOCS", 37), ("WINDOW_DOCS", 5), ("SHORT_SHARE", 4)):
        sizes[name] = getattr(lexical_search, name)
        setattr(lexical_search, name, value)
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()),
                                            pa.array([t for _, t in docs], pa.string())], ["doc_id", "text"])
        segments = list(lexical_search._segments(vocabulary)(iter([batch])))
        assert len(segments) > 5
        bags = [split(t) for _, t in docs]
        df = Counter(t for b in bags for t in set(b))
        weights = np.array([term_weight(len(docs), df[t.decode()]) for t in block.vocabulary], np.int64)
        given = type("Given", (), {"value": (block, weights, (len(docs), sum(map(len, bags))))})
        found = [r for b in lexical_search._search(given, 7)(iter(segments)) for r in b.to_pylist()]
    finally:
        for name, value in sizes.items():
            setattr(lexical_search, name, value)
    ranks = Counter()
    got = []
    for r in found:
        ranks[r["item_id"]] += 1
        got.append((r["item_id"], ranks[r["item_id"]], r["doc_id"], r["score"]))
    assert sorted(got, key=repr) == want


def test_items_in_several_blocks(spark, tiny):
    docs, items = corpus(4, 60)
    assert run(spark, docs, items, top=4) == brute(docs, items, 4)


def test_odd_rows(spark):
    docs = list(enumerate(EDGE_TEXTS)) + [(None, "one two"), (3, "one"), (3, "one"), (77, "ONE TWO É é"),
                                         (78, "words " * 4000 + "rare")]
    items = [(1, "one two two"), (1, "one two two"), (1, "very long"), (2, None), (3, ""), (4, "—!"), (None, "É long"),
             (5, "absent"), (6, "rare words"), (7, "한국어 nbsp")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == []


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 50)
    text = " ".join(random_text(random.Random(1), 500)) + "x" * 300 + " end"
    assert [t for part in lexical_search._slices(text.encode()) for t in part] == lexical_search.terms(text)
