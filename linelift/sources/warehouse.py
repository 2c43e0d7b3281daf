"""Store and read the four portfolio tables as Parquet.

This is the production layout: the reports read stored tables instead of
deriving them. Paths must be on storage every executor sees; ``shared_path``
places them under the session's ``spark.checkpoint.dir``.

Layout below the path that a caller names:

- ``<version>/<table>``: the tables of one write. Account dimension and monthly facts are
  bucketed by account, the facts inside their year partitions. A report's per-account
  aggregate and its account joins then read co-located buckets and shuffle neither; the
  year floor prunes whole directories. Applications are not bucketed, as one account may hold
  a large share of them: reports collapse them before they meet the buckets.
- ``_versions``: one small file per finished write. A write becomes visible by appending its
  file there, after all its tables are complete; readers open the newest version. So a
  failed or concurrent write never shows anybody half of its tables.

Buckets are read through external tables in the session's catalog, which
``read_tables`` declares (dropping them leaves the files).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linelift.operators.facts import accounts_repeat
from linelift.sources.schema import SCHEMAS, TableSource, conform

BUCKET_KEY = "account_id"
BUCKETED = ("accounts", "account_month", "profit_month")
PARTITION_BY = {"account_month": ["yr"], "profit_month": ["yr"]}
# Order inside each written file: row-group min/max statistics then let the
# pushed date-window filters skip most of the applications table.
SORT_BY = {"applications": ["application_date"]}

VERSIONS = T.StructType([
    T.StructField("written_at", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("buckets", T.IntegerType()),
    T.StructField("accounts_unique", T.BooleanType()),
])


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory the session names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("spark.checkpoint.dir is not set; pass an explicit shared path")
    return f"{base.rstrip('/')}/{name}"


def default_buckets(spark: SparkSession) -> int:
    """As many buckets as the session shuffles to, so that what joins a bucketed table is
    dealt to its buckets and the table itself stays where it is."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever storage it is."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


# ---------------------------------------------------------------- bucketed Parquet

def write_bucketed(df: DataFrame, path: str, buckets: int, partition_by: Sequence[str] = (),
                   key: str = BUCKET_KEY) -> None:
    """Write ``df`` as Parquet in ``buckets`` buckets of ``key`` (and in partitions): one
    file per bucket and partition, sorted by the key."""
    name = f"linelift_write_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    try:
        writer.format("parquet").option("path", path).saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, buckets: int, name: str,
                  partition_by: Sequence[str] = (), key: str = BUCKET_KEY) -> DataFrame:
    """What ``write_bucketed`` wrote, through the external table ``name``."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        partitions = f"PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {partitions} "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
        if partition_by:
            spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name).select(*schema.names)


# ---------------------------------------------------------------- versions

def versions(spark: SparkSession, path: str) -> list[tuple[str, str, int, bool]]:
    """(written_at, version, buckets, accounts_unique) of every finished write, oldest first."""
    try:
        rows = spark.read.schema(VERSIONS).json(f"{path.rstrip('/')}/_versions").collect()
    except AnalysisException:  # nothing was ever written
        return []
    return sorted(tuple(r) for r in rows)


def write_tables(tables: TableSource, path: str, mode: str = "overwrite",
                 buckets: int | None = None) -> str:
    """Store the four tables under ``path`` as a new version, and make it the one that
    readers open once all of them are written; the version's name.

    ``mode``: "overwrite" replaces what readers see, "error" refuses if there is a version.
    ``buckets``: of the account-bucketed tables (default: the session's shuffle partitions).
    A write that fails changes nothing for readers; of concurrent writes the last to finish
    is read. Older versions stay on disk until ``vacuum_tables``.
    """
    if mode not in ("overwrite", "error", "errorifexists"):
        raise ValueError(f"mode must be 'overwrite' or 'error', got {mode!r}")
    path, frames = path.rstrip("/"), tables.as_dict()
    spark = next(iter(frames.values())).sparkSession
    if mode != "overwrite" and versions(spark, path):
        raise FileExistsError(f"{path} holds tables already")
    buckets = buckets or default_buckets(spark)
    version = f"v{uuid.uuid4().hex}"
    for name, df in frames.items():
        target = f"{path}/{version}/{name}"
        if name in BUCKETED:
            write_bucketed(df, target, buckets, PARTITION_BY.get(name, ()))
        else:
            df.sortWithinPartitions(*SORT_BY[name]).write.parquet(target)
    written = StoredTables(spark, path, version, buckets, False)
    unique = not accounts_repeat(written.accounts)  # bucketed by account: no shuffle
    now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds")
    (spark.createDataFrame([(now, version, buckets, unique)], VERSIONS).coalesce(1)
     .write.mode("append").json(f"{path}/_versions"))
    return version


def vacuum_tables(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Delete all finished versions but the ``keep`` newest; their names. Readers that still
    have one of them open must be done."""
    old = versions(spark, path)[:-keep] if keep > 0 else []
    for _, version, *_ in old:
        for name in BUCKETED:
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(version, name)}")
        delete_folder(spark, f"{path.rstrip('/')}/{version}")
    return [version for _, version, *_ in old]


def _table_name(version: str, table: str) -> str:
    return f"linelift_{version}_{table}"


class StoredTables:
    """The four tables of one version; same attributes as :class:`Tables`.

    Each table is opened (file listing, schema check) on first access, so a
    report touches only the tables it reads. ``account_buckets``: into how many
    buckets of accounts the dimension and the monthly facts are dealt.
    ``accounts_unique``: found out when they were written.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, buckets: int,
                 accounts_unique: bool):
        self._spark, self._path = spark, f"{path.rstrip('/')}/{version}"
        self.version, self.account_buckets = version, buckets
        self.accounts_unique = accounts_unique

    def _open(self, name: str) -> DataFrame:
        schema, path = SCHEMAS[name], f"{self._path}/{name}"
        if name in BUCKETED:
            df = open_bucketed(self._spark, path, schema, self.account_buckets,
                               _table_name(self.version, name), PARTITION_BY.get(name, ()))
        else:
            df = self._spark.read.schema(schema).parquet(path)
        return conform(df, schema, name)

    @cached_property
    def applications(self) -> DataFrame:
        return self._open("applications")

    @cached_property
    def accounts(self) -> DataFrame:
        return self._open("accounts")

    @cached_property
    def account_month(self) -> DataFrame:
        return self._open("account_month")

    @cached_property
    def profit_month(self) -> DataFrame:
        return self._open("profit_month")

    @property
    def reopened(self) -> "StoredTables":
        """These tables; ``accounts`` holds the openings that were written."""
        return self

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    def close(self) -> None:
        """Take the external tables out of the session's catalog; the files stay."""
        for name in BUCKETED:
            self._spark.sql(f"DROP TABLE IF EXISTS {_table_name(self.version, name)}")


def read_tables(spark: SparkSession, path: str, version: str | None = None) -> StoredTables:
    """The newest version of the tables under ``path`` (or the one named), opened lazily."""
    found = {v: rest for _, v, *rest in versions(spark, path)}
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no {'such version' if found else 'finished tables'} under {path}")
    version = version or list(found)[-1]
    return StoredTables(spark, path, version, *found[version])
