"""Extra columns, named like results and internals, change no operator's rows."""

import pytest
from llm_helpers import TOKENIZERS

from linelift.llm import (bpe, decontaminate, exact_dedup, jaccard_join, lexical_search, packing, quality,
                          secret_scan, sharding, token_counts)
from linelift.llm.queries import BPE_PATTERN

NAMES = ("key bucket cls n l m k shingle comp most rank prefix before held size set hits a b cell spot shard depth "
         "_row _prefix _found _bits _at bits at found blob rules base spans ranked score held_out predicted ids "
         "n_tokens pos word item item_id start length doc_tokens pack_group sequence_id offset keep_id kept label "
         "_label _jaccard_size _jaccard_class whitened component salt terms counts n_docs gram n_bytes_").split()

TEXTS = ["token = abcdefgh1 and more words here", "one two three four five six seven eight nine ten", None, "",
         "one two three four five six seven eight nine ten", "One two three four five six seven eight nine eleven",
         "a " * 300, "the benchmark item holds these words in this very order", "İ!", "x"]
ITEMS = [(1, "benchmark item holds these words"), (2, "one two three"), (3, None)]


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")


OPERATORS = {
    "jaccard_join": lambda s, d: jaccard_join.jaccard_join(d, k=2, percent=60),
    "jaccard_keep_one": lambda s, d: jaccard_join.keep_one(d, k=2, percent=60).select("doc_id", "text"),
    "extendible_shards": lambda s, d: sharding.extendible_shards(
        d.selectExpr("*", "length(text) AS n_bytes"), limit=60).select("doc_id", "shard", "depth", "shard_bytes"),
    "quality": lambda s, d: quality.quality(d, labels(s)),
    "token_counts": lambda s, d: token_counts.token_counts(d, tokenizer=f"{TOKENIZERS}/byte_bpe_50k.json"),
    "secrets": lambda s, d: secret_scan.secrets(d).select("doc_id", "n_assign", "base_sha256", "spans"),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d).select("doc_id", "keep_id", "group_size", "kept"),
    "contaminated": lambda s, d: decontaminate.contaminated(d, items(s)),
    "clean": lambda s, d: decontaminate.clean(d, items(s)).select("doc_id", "text"),
    "pack": lambda s, d: packing.pack(d, tokenizer=f"{TOKENIZERS}/word_bpe_49k.json").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens"),
    "bpe": lambda s, d: bpe.round_trip(d, ranks=f"{TOKENIZERS}/byte_bpe_50k.tiktoken", pattern=BPE_PATTERN),
    "ranked_search": lambda s, d: lexical_search.ranked_search(d, items(s)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_same_rows_with_extra_columns(spark, name):
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(2)
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    wide = spark.createDataFrame([(i, t, *["x"] * len(NAMES)) for i, t in enumerate(TEXTS)], schema).coalesce(2)
    run = OPERATORS[name]
    assert sorted(map(tuple, run(spark, wide).collect()), key=repr) == sorted(
        map(tuple, run(spark, plain).collect()), key=repr)
