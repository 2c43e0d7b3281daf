"""Exact deduplication against a dictionary."""

import hashlib
import random
import re

import pytest
from llm_helpers import EDGE_TEXTS

from linelift.llm import exact_dedup
from linelift.llm.exact_dedup import grace_classes


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("bucket_bytes,bits", [(10**9, 64), (50, 64), (50, 3), (1, 0)])
def test_grace_compares_complete_content(tmp_path, bucket_bytes, bits):
    rng = random.Random(1)
    contents = [f"content {i}".encode() * rng.randint(1, 4) for i in range(60)]
    records = [(int(hashlib.md5(c).hexdigest(), 16) % 2**bits, c, 1)
               for c in rng.choices(contents, k=500) + [contents[0]] * 300]
    got = list(grace_classes(iter(records), lambda a, b: a + b, bucket_bytes=bucket_bytes, fan_out=4,
                             folder=str(tmp_path)))
    want = {}
    for _, c, n in records:
        want[c] = want.get(c, 0) + n
    assert len(got) == len(want) and {c: n for _, c, n in got} == want
    assert not list(tmp_path.iterdir())


def test_a_shared_digest_is_an_error():
    with pytest.raises(ValueError, match="share the hash"):
        list(grace_classes(iter([(5, b"a", 1), (5, b"b", 1)]), lambda a, b: a + b, strict=True))


@pytest.mark.parametrize("bucket_bytes", [exact_dedup.BUCKET_BYTES, 100])
def test_groups(docs, bucket_bytes):
    rng = random.Random(2)
    rows = list(enumerate(EDGE_TEXTS)) + [(50 + i, t) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "one"), (7, "one"), (7, "o ne"), (8, "o n e"), (9, " o\tne"), (9, " o\tne")]
    rows += [(1000 + i, rng.choice(["hot text", "hot  text", f"cold {i % 40}"])) for i in range(400)]
    rng.shuffle(rows)
    df = docs(rows, "keep_id kept group_size lang").repartition(5)
    got = exact_dedup.exact_dedup(df, bucket_bytes=bucket_bytes).collect()
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(((-len(text or ""), doc_id is None, doc_id or 0),
                                                    doc_id))
    assert len(got) == len(rows)
    kept = {}
    for r in got:
        key = normal(r["text"])
        group = groups[key]
        assert r["keep_id"] == min(group)[1] and r["group_size"] == len(group)
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()
        if r["kept"]:
            kept[key] = kept.get(key, 0) + 1
            assert (-len(r["text"] or ""), r["doc_id"]) == (min(group)[0][0], min(group)[1])
    assert kept == {key: 1 for key in groups}


def test_empty(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
