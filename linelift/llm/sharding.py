"""Sharding by extendible hashing.

A directory indexed by the first bits of each row's hash starts with a single shard.
A shard over its byte limit splits on the next bit of the hash, and only that shard; this
repeats until every shard fits. Byte sums are additive, so the splits of
``LEVEL_BITS`` bits are decided from one aggregation by hash prefix: a row's shard is
the shortest prefix of its hash whose bytes fit. Prefixes that are still too large go
through another level on their next bits; each level's directory comes from that
level's rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linelift.llm.common import materialize, need_columns
from linelift.llm.native import free_names

LEVEL_BITS = 12
"""Bits per level: the first level's directory has 4,096 entries at most."""
KEY_BITS = 48
"""Bits of the key's hash. As many bits of the row's number follow, so that rows of one
key, a hot key's or repeated rows, can still be split."""
LIMIT_BYTES = 16 << 20


def hash_bits(value: Column) -> Column:
    """The first 48 bits of the value's MD5 as a string of 0 and 1 (a null is hashed as '')."""
    digest = F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))
    return F.lpad(F.conv(F.substring(digest, 1, 12), 16, 2), KEY_BITS, "0")


def _directory(cells: DataFrame, done: int, limit: int) -> DataFrame:
    """Shard of each prefix of ``done + LEVEL_BITS`` bits, null where it must split further."""
    depths = F.explode(F.sequence(F.lit(done), F.lit(done + LEVEL_BITS))).alias("depth")
    sums = (cells.select("prefix", "bytes", "rows", depths)
            .groupBy(F.expr("substring(prefix, 1, depth)").alias("shard"), "depth")
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
            .where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
    found = (cells.select("prefix", depths)
             .withColumn("shard", F.expr("substring(prefix, 1, depth)"))
             .join(sums, ["shard", "depth"])
             .groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes",
                                                   "shard_rows")).alias("at")))
    return cells.select("prefix").join(found, "prefix", "left").select("prefix", "at.*")


def extendible_shards(rows: DataFrame, *, key: str = "doc_id", size: str = "n_bytes",
                      limit: int = LIMIT_BYTES) -> DataFrame:
    """Assign every row to a shard of at most ``limit`` bytes; adds shard (its hash prefix as
    bits, empty for the only shard), depth, shard_bytes and shard_rows.

    ``key``: the column whose hash decides; ``size``: the row's bytes (null counts 0).
    Columns of the added names are replaced, all others pass through. Rows of one key stay
    together as long as they fit; a null key is a key. Only a single row that is
    larger than the limit makes a shard above it. An empty table gives no rows.
    """
    need_columns(rows, key, size)
    added = ("shard", "depth", "shard_bytes", "shard_rows")
    kept = rows.drop(*added) if not {key, size} & set(added) else rows
    passed = [c for c in rows.columns if c not in added]
    bits, length, at, entry_prefix, found = free_names(kept, "bits", "size", "at", "prefix", "found")
    table = materialize(
        kept.withColumn(bits, F.concat(hash_bits(F.col(key)), hash_bits(F.monotonically_increasing_id())))
        .withColumn(length, F.coalesce(F.col(size).cast("long"), F.lit(0))), "shards")
    assigned, todo, done, large = table, table, 0, True
    while large and done < 2 * KEY_BITS:
        prefix = F.substring(bits, 1, done + LEVEL_BITS)
        cells = (todo.groupBy(prefix.alias("prefix"))
                 .agg(F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("rows")))
        level = materialize(_directory(cells, done, limit), "directory")
        entry = level.select(F.col("prefix").alias(entry_prefix),
                             F.when(F.col("shard").isNotNull(), F.struct(*added)).alias(found))
        if done == 0:  # 2 ** LEVEL_BITS entries at most
            entry = F.broadcast(entry)
        place = F.col(found) if done == 0 else F.coalesce(at, found)
        assigned = (assigned.join(entry, prefix == F.col(entry_prefix), "left")
                    .withColumn(at, place).drop(entry_prefix, found))
        done += LEVEL_BITS
        split = level.where(F.col("shard").isNull()).select(F.col("prefix").alias(entry_prefix))
        large = not split.isEmpty()
        todo = todo.join(split, prefix == F.col(entry_prefix), "left_semi")
    return assigned.select(*passed, *[F.col(at)[c].alias(c) for c in added])


def write_shards(rows: DataFrame, path: str, **kw) -> None:
    """Write each shard to its own folder ``shard=<bits>`` below ``path``."""
    (extendible_shards(rows, **kw).withColumn("shard", F.concat(F.lit("b"), "shard"))
     .repartition("shard").write.partitionBy("shard").parquet(path))
