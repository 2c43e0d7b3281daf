"""The Bloom filter keeps every key and few others, and is bounded."""

from pyspark.sql import functions as F

from linelift.operators import bloom
from linelift.operators.bloom import bloom_filter, may_contain


def test_every_key_passes_and_few_others(spark):
    keys = spark.range(0, 20_000, 2).withColumnRenamed("id", "k")
    rows = spark.range(0, 200_000).withColumn("k", F.col("id"))
    kept = rows.where(may_contain(keys, "k"))
    assert kept.where("k < 20000 and k % 2 = 0").count() == 10_000
    assert kept.count() - 10_000 < 0.01 * 190_000


def test_size_follows_the_count_and_is_bounded(spark):
    for n, words in ((0, 64), (1, 64), (300, 64), (10_000, 2048), (100_000, 32_768)):
        got = bloom_filter(spark.range(n), "id").select(F.size("words")).first()[0]
        assert got == words, n
    old = bloom.MOST_WORDS
    bloom.MOST_WORDS = 128
    try:
        keys = spark.range(50_000)
        assert bloom_filter(keys, "id").select(F.size("words")).first()[0] == 128
        assert keys.where(may_contain(keys, "id")).count() == 50_000  # full, and still no key is lost
    finally:
        bloom.MOST_WORDS = old


def test_nulls_strings_and_no_keys(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in rows.where(may_contain(rows.where("k = 'a'"), "k")).collect()] == ["a"]
    assert rows.where(may_contain(rows.where("k = 'none'"), "k")).isEmpty()
    assert rows.where(may_contain(rows.where("k is null"), "k")).isEmpty()
