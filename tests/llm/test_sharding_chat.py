"""Extendible hashing and chat formatting, both Spark SQL functions only."""

import hashlib
import random
import re

import pytest

from linelift.llm import chat, sharding


def bits_of(key):
    digest = hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:12]
    return f"{int(digest, 16):048b}"


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, n_bytes long, shard string, _at string")


@pytest.mark.parametrize("limit", [40, 500, 10**9])
def test_shards_are_the_shortest_prefixes_that_fit(spark, limit):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 30), "x", "y") for i in range(600)]
    got = sharding.extendible_shards(sized(spark, rows).repartition(4), limit=limit).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    for r in got:
        own = bits_of(r["doc_id"])
        for depth in range(0, r["depth"] + 1):
            inside = [b for d, b, *_ in rows if bits_of(d).startswith(own[:depth])]
            fits = sum(inside) <= limit or len(inside) == 1
            assert fits == (depth == r["depth"])
        assert r["shard"] == own[:r["depth"]]
        assert (r["shard_bytes"], r["shard_rows"]) == (sum(inside), len(inside))


def test_hot_keys_split_by_row_and_large_rows_stand_alone(spark):
    rows = [(None, 10, "x", "y")] * 50 + [(7, 10, "x", "y")] * 50 + [(8, 1000, "x", "y"), (9, None, "x", "y")]
    got = sharding.extendible_shards(sized(spark, rows), limit=100).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total.setdefault(r["shard"], []).append(r["n_bytes"] or 0)
    assert all(sum(v) <= 100 or v == [1000] for v in total.values())
    assert all(sum(total[r["shard"]]) == r["shard_bytes"] for r in got)


def test_empty_and_level_edges(spark):
    assert sharding.extendible_shards(sized(spark, [])).count() == 0
    one = sharding.extendible_shards(sized(spark, [(1, 5, "x", "y")]), limit=1).collect()
    assert [(r["shard"], r["depth"], r["shard_bytes"]) for r in one] == [("", 0, 5)]


def test_write_shards(spark, tmp_path):
    rows = [(i, 10, "x", "y") for i in range(40)]
    sharding.write_shards(sized(spark, rows), str(tmp_path / "s"), limit=100)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 40
    assert len(list((tmp_path / "s").glob("shard=*"))) > 3


TURNS = [
    (1, 0, "system", "be <nice>"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "\\[ \\\\< <\\"),
    (2, 0, "user", "hi"), (2, 1, "user", "again"),
    (3, 0, "assistant", None), (3, 1, "tool", "[ROLE]x[/ROLE] [/TURN]"), (3, 2, None, "no role"),
    (4, None, "user", ""), (4, None, "assistant", ""), (4, None, "assistant", "tie 🙂 한"),
    (None, 0, "user", "null id"), (None, 0, "user", "null id"),
    (5, 0, "[x]<y>\\", "odd role"), (6, 0, "system", "alone"),
]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "",
                                       r[3] is not None, r[3] or ""))


@pytest.mark.parametrize("block", [256, 2])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    long = [(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} <[\\") for i in range(600)]
    turns = spark.createDataFrame([(*r, "x") for r in TURNS + long],
                                  "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(turns.repartition(3))
    back = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    digests = {r["conv_id"]: r for r in chat.conversation_digests(formatted).collect()}
    for conv in {r[0] for r in TURNS + long}:
        want = ordered([r for r in TURNS + long if r[0] == conv])
        got = back[conv]
        pairs = [(role or "", text or "") for _, _, role, text in want]
        assert [(t["role"], t["text"]) for t in got["turns"]] == pairs
        loss = "".join(text for role, text in pairs if role == "assistant")
        assert got["loss_text"] == loss
        d = digests[conv]
        joined = "".join(f"{role}\n{text}\n" for role, text in pairs)
        assert d["turns_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert (d["n_turns"], d["loss_chars"]) == (len(pairs), len(loss))
        assert d["formatted_chars"] == len(got["formatted"])
        path = "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "x") for r, _ in pairs)
        assert d["valid"] == bool(re.fullmatch("s?(ua)*u?", path) and path != "s")


def test_no_control_string_survives_in_a_text(spark):
    marks = [m for r in chat.LLAMA_LIKE.roles.values() for m in (r.before, r.after)] + ["<s>", "[/ROLE]"]
    df = spark.createDataFrame([(m * 2 + "\\" + m,) for m in marks], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in marks)


def test_segments(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    rows = chat.turn_segments(turns).collect()
    assert len(rows) == len(TURNS)
    for r in rows:
        assert [s["loss"] for s in r["segments"]] == [False, r["role"] == "assistant", False]
    assert {(r["conv_id"], r["position"]): r["valid"] for r in rows if r["conv_id"] in (1, 2)} == {
        (1, 1): True, (1, 2): True, (1, 3): True, (2, 1): True, (2, 2): False}


def test_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_conversations(turns)).count() == 0


def test_columns_of_any_name_pass_through(spark):
    names = "bits size at prefix found _row _prefix _found _bits _size _at cells row depth_"
    rows = [(i, 10, *["x"] * len(names.split())) for i in range(60)]
    schema = "doc_id long, n_bytes long, " + ", ".join(f"{n} string" for n in names.split())
    got = sharding.extendible_shards(spark.createDataFrame(rows, schema), limit=100)
    assert got.columns == ["doc_id", "n_bytes", *names.split(), "shard", "depth", "shard_bytes", "shard_rows"]
    assert {r["_at"] + r["bits"] + r["prefix"] for r in got.collect()} == {"xxx"} and got.count() == 60


def test_running_sums(spark):
    from pyspark.sql import functions as F

    from linelift.llm.native import running_sums

    rows = [([],), ([5],), (list(range(255)),), (list(range(256)),), (list(range(257)),), ([3] * 100_000,), (None,)]
    got = spark.createDataFrame(rows, "v array<bigint>").select("v", running_sums(F.col("v")).alias("s")).collect()
    for r in got:
        want, at = [], 0
        for x in r["v"] or []:
            want.append(at)
            at += x
        assert r["s"] == want


def test_loss_spans_cover_the_loss_text(spark):
    rng = random.Random(12)
    rows = [(c, i, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a<[\\b", "é🙂", "", None]))
            for c in range(4) for i in range([3, 256, 257, 700][c])]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat.read_back(made).collect():
        inside = "".join(r["formatted"][s:e] for s, e in r["loss_spans"])
        assert re.sub(r"([\\<\[])\\", r"\1", inside) == r["loss_text"]
        assert r["loss_text"] == "".join(t or "" for c, _, role, t in rows if c == r["conv_id"] and role == "assistant")


def test_long_conversations_take_time_in_proportion(spark):
    import time

    def seconds(n):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role",
                                          "concat('text [', id) AS text")
        t = time.time()
        row = chat.conversation_digests(chat.format_conversations(turns)).first()
        assert row["n_turns"] == n and row["valid"]
        return time.time() - t

    seconds(100)
    few = seconds(6000)
    assert seconds(48_000) < 16 * few + 5
