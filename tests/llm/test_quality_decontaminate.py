"""Quality classifier by held-out accuracy, decontamination by planted copies and brute force."""

import random
import zlib

import numpy as np
import pytest
from llm_helpers import EDGE_TEXTS, random_text

from linelift.llm import decontaminate
from linelift.llm import decontaminate as D
from linelift.llm import quality as Q

SF = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_held_out_accuracy(spark):
    labels = read(spark, "labels")
    got = Q.quality(read(spark, "documents"), labels).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held["quality"]).mean() > 0.95


def test_held_out_labels_do_not_matter(spark, docs):
    from pyspark.sql import functions as F

    texts, labels = read(spark, "documents").limit(200), read(spark, "labels")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    assert np.array_equal(Q.train(texts, labels), Q.train(texts, flipped))


def test_scores_use_the_text_alone(spark, docs):
    rows = list(enumerate(EDGE_TEXTS)) + [(None, "no id"), (4, "two words"), (4, "two words")]
    weights = np.random.default_rng(1).normal(size=(1 << Q.BITS) + 1)
    got = Q.scores(docs(rows, "score lang held_out"), weights).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"] or "", set()).add(r["score"])
    assert all(len(s) == 1 for s in by_text.values())


def test_sparse_dot_is_the_dot_product():
    weights = np.random.default_rng(2).normal(size=(1 << Q.BITS) + 1)
    for text in EDGE_TEXTS + ["The THE the*** 12 12 | | a b a b"]:
        index, values = Q.sparse(text)
        assert Q.sparse_dot(weights, text) == pytest.approx(float(weights[index] @ values))


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(3)
    model = Q.Ftrl(50)
    for _ in range(3000):
        index = np.sort(rng.choice(50, 5, replace=False))
        model.update(index, np.ones(5), int(7 in index))
    w = model.weights()
    assert w[7] > 2 and np.abs(np.delete(w[:50], 7)).max() < w[7] / 3


def test_no_labels_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    got = Q.quality(docs([(1, "a"), (None, None)]), labels).collect()
    assert [r["score"] for r in got] == [0.5, 0.5] and {r["held_out"] for r in got} <= {True, False}
    assert Q.quality(docs([]), labels).count() == 0


def align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (D.MATCH if x == y else D.MISMATCH),
                                  h[i, j + 1] + D.GAP, h[i + 1, j] + D.GAP)
    return h.max()


def test_alignment_against_the_plain_recurrence():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 6, (40, 12)).astype(np.uint64)
    b = rng.integers(0, 6, (40, 17)).astype(np.uint64)
    a_len = rng.integers(1, 13, 40)
    got = D.local_scores(a, a_len, b)
    assert got.tolist() == [align(a[k, :a_len[k]].tolist(), [x or -1 for x in b[k].tolist()]) for k in range(40)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    items = [(i, " ".join(random_text(rng, rng.randint(15, 50), 3000)).capitalize() + ".") for i in range(30)]
    items += [(100, "Two words"), (101, ""), (102, None), (None, " ".join(random_text(rng, 20, 3000)))]
    rows, dirty = [], set()
    for d in range(300):
        text = random_text(rng, rng.randint(0, 300), 3000)
        if d % 3 == 0:
            item, passage = rng.choice(items[:30])
            passage = passage.rstrip(".").lower().split()
            if d % 2:
                for _ in range(max(1, len(passage) // 8)):
                    k = rng.randrange(len(passage))
                    passage[k:k + 1] = rng.choice(([], ["changed"], [passage[k], "more"]))
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "!"]) for w in passage]
            dirty.add((d, item))
        rows.append((d, " ".join(text)))
    return items, rows, dirty


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 60])
def test_planted_passages_are_found_and_clean_rows_left(spark, docs, planted, block_words):
    items, rows, dirty = planted
    rows = rows + [(900 + i, t) for i, t in enumerate(EDGE_TEXTS) if i != 4]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = docs(rows, "score item_id lang").repartition(3)
    got = D.contaminated(df, benchmark, block_words=block_words).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == dirty and len(got) == len(dirty)
    kept = D.clean(df, benchmark, block_words=block_words)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in dirty}


def test_against_aligning_everything(spark):
    """Every pair of the test tables whose words align that well is found, and no other."""
    texts = read(spark, "documents").limit(150)
    items = [(r["item_id"], r["text"]) for r in read(spark, "benchmark").collect()]
    block = D.make_block(items, 3)
    want = set()
    for r in texts.collect():
        words = D.text_words(r["text"])[:4000]
        padded = np.tile(np.concatenate([words, np.zeros(1, np.uint64)]), (len(items), 1))
        a = np.zeros((len(items), max(map(len, block.tokens))), np.uint64)
        for i, t in enumerate(block.tokens):
            a[i, :len(t)] = t
        lengths = np.array([len(t) for t in block.tokens])
        scores = D.local_scores(a, lengths, padded) / (D.MATCH * lengths)
        want |= {(r["doc_id"], items[i][0]) for i in np.flatnonzero(scores >= D.MIN_SCORE)}
    got = D.contaminated(texts, read(spark, "benchmark")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_empty_sides(spark, docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs([(1, "a b c")]), benchmark).count() == 0
    assert D.clean(docs([(1, "a b c")]), benchmark).count() == 1
    some = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert D.contaminated(docs([]), some).count() == 0
    assert D.contaminated(docs([(5, "x A, b! c d"), (5, "x A, b! c d"), (None, "a b c d")]), some).count() == 3


def test_query_against_plain_training_and_scoring(spark):
    """op3 from its definition: dictionaries instead of arrays, one feature at a time."""
    import hashlib
    import math
    import zlib

    import xxhash
    from linelift.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()
              if r["quality"] is not None}

    def shape(word):
        kinds = ["0" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word]
        return "".join(k for i, k in enumerate(kinds) if not (i > 1 and kinds[i - 1] == kinds[i - 2] == k))

    mix = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def place(kind, *parts):
        h = kind
        for part, m in zip(parts, mix):
            h = ((h ^ part) * m) % 2**64
            h ^= h >> 32
        return h >> 64 - 18

    def bag(text):
        words = text.split()
        w = [xxhash.xxh32_intdigest(x.lower()) for x in words]
        f = [xxhash.xxh32_intdigest(shape(x), seed=1) for x in words]
        kinds = [[place(1, a) for a in w], [place(2, a) for a in f],
                 [place(3, *g) for g in zip(w, w[1:])], [place(4, *g) for g in zip(f, f[1:])],
                 [place(5, int(a == b)) for a, b in zip(w, w[1:])],
                 [place(6, *g) for g in zip(f, f[1:], f[2:])], [place(7, int(a == b)) for a, b in zip(w, w[2:])]]
        out = {}
        for kind in kinds:
            for i in kind:
                out[i] = out.get(i, 0.0) + 8.0 / len(kind)
        return out

    def sigmoid(x):
        return 1 / (1 + math.exp(-min(max(x, -35.0), 35.0)))

    z, n = {}, {}

    def weight(i):
        s = z.get(i, 0.0)
        return 0.0 if abs(s) <= 0.02 else -(s - math.copysign(0.02, s)) / ((1 + math.sqrt(n[i])) / 0.3 + 0.1)

    train = sorted((d for d in labels if d in texts and zlib.crc32(str(d).encode()) % 5),
                   key=lambda d: hashlib.md5(str(d).encode()).hexdigest())[:8192]
    rows = [({**bag(texts[d]), "bias": 1.0}, labels[d]) for d in train]
    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            features, label = rows[k]
            error = sigmoid(sum(v * weight(i) for i, v in features.items())) - label
            for i, v in features.items():
                g, old, w = error * v, n.get(i, 0.0), weight(i)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / 0.3 * w
    got = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        score = sigmoid(sum(v * weight(i) for i, v in bag(text).items()) + weight("bias"))
        assert abs(got[d]["score"] - score) < 1e-6
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.3)
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)


def edited(rng, words, share, vocabulary):
    out = []
    for w in words:
        if rng.random() >= share:
            out.append(w)
        else:
            kind = rng.randrange(3)
            out += [[rng.choice(vocabulary)], [], [w, rng.choice(vocabulary)]][kind]
    return out


@pytest.mark.parametrize("share,least", [(0.1, 1.0), (0.2, 0.97), (0.3, 0.9)])
def test_recall_on_edited_copies(spark, share, least):
    rng = random.Random(int(share * 100))
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(25, 60))]) for i in range(120)]
    docs = [(i, [rng.choice(vocabulary) for _ in range(300)]) for i in range(200)]
    for i, words in items:
        at = rng.randrange(300)
        docs.append((1000 + i, docs[i][1][:at] + edited(rng, words, share, vocabulary) + docs[i][1][at:]))
    found = decontaminate.contaminated(
        spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(pairs & {(1000 + i, i) for i, _ in items}) >= least * len(items)
    assert not {d for d, i in pairs if d != 1000 + i}


def test_long_items_and_repeated_words_stay_bounded():
    import resource

    rng = random.Random(2)
    item = [f"w{rng.randrange(50_000)}" for _ in range(20_000)]
    block = decontaminate.make_block([(i, "same " * 12) for i in range(50)] + [(99, " ".join(item))], 3)
    finder = decontaminate._Finder(block.grams)
    texts = [decontaminate.text_words(t) for t in ("same " * 5000, " ".join(item[3000:6000]), " ".join(item))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    best = {}
    for row, i, score, *_ in decontaminate._matches(block, finder, 3, iter(texts)):
        best[row, i] = max(score, best.get((row, i), 0))
    assert all(best[0, i] == 1.0 for i in range(50)) and best[2, 50] == 1.0 and 0.1 < best[1, 50] < 0.2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000  # KB
