"""A store of keys (urls, content hashes) that new batches are held against, without moving the store.

The keys lie in a table bucketed by key, so that a join with new keys moves the new ones alone. Beside it lie Bloom
filters, one for each *slot* (a hash of the key), built by Spark's bitmap aggregates; each batch adds its own, and those
of a slot merge by a bitwise or. A new key first meets its slot's filter; only keys that may be stored go on to the
exact join, and if they are few, only their buckets of the store are read. A filter far too small makes more keys go on,
never a wrong answer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.sources.scratch import landed

#: Bits of a filter (a bitmap of Spark's aggregates) and bits that a key sets.
BITS, HASHES = 32_768, 4
#: Keys for which a slot is laid out: then one new key in some 80 goes on without being stored.
KEYS_A_SLOT = 3_000
#: Up to so many possibly stored keys name the buckets that are read; more of them meet all buckets anyway.
NAMED_KEYS = 512


def _places(key):
    first, second = (F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS)) for k in (1, 2))
    return F.array(*[F.pmod(first + i * second, F.lit(BITS)).cast("int") for i in range(HASHES)])


def _is_set(bits, place):
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, place % 8) == 1


class KeyStore:
    """Keys at a path: ``keys`` (bucketed), ``filters`` (slot, bits) and ``layout`` (buckets, slots)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, slots: int):
        self.spark, self.path, self.buckets, self.slots = spark, path, buckets, slots
        self.name = "keys_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (key STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}/keys'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected: int = 1_000_000, buckets: int | None = None) -> KeyStore:
        """A new, empty store laid out for so many keys; it may grow beyond."""
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        slots = max(1, -(-expected // KEYS_A_SLOT))
        spark.createDataFrame([(buckets, slots)], "buckets int, slots int").coalesce(1).write.parquet(f"{path}/layout")
        spark.createDataFrame([], "slot int, bits binary").write.parquet(f"{path}/filters")
        return cls(spark, path, buckets, slots)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeyStore:
        return cls(spark, path, *spark.read.parquet(f"{path}/layout").first())

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, **layout) -> KeyStore:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
        there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
        return cls.open(spark, path) if there else cls.create(spark, path, **layout)

    def _slot(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.slots)).cast("int")

    def add(self, keys: DataFrame, key: str = "key") -> None:
        """Stores the keys of a batch; null ones are left out. The filters go first: should the second write fail, some
        keys pass a filter in vain until the batch runs again. Running again stores a key twice, which changes nothing."""
        own = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().repartition(self.buckets, "key")
        bits = own.select(self._slot(F.col("key")).alias("slot"), F.explode(_places(F.col("key"))).alias("place")).groupBy("slot").agg(F.expr("bitmap_construct_agg(place)").alias("bits"))
        bits.coalesce(8).write.mode("append").parquet(f"{self.path}/filters")
        own.write.mode("append").format("parquet").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.name)

    def filters(self) -> DataFrame:
        """slot, bits: the filters of all batches merged."""
        return self.spark.read.schema("slot int, bits binary").parquet(f"{self.path}/filters").groupBy("slot").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))

    def merge_filters(self) -> None:
        """One filter for each slot instead of one for each batch and slot; between batches only."""
        merged = f"{self.path}/filters-merged"
        self.filters().write.mode("overwrite").parquet(merged)
        self.spark.read.parquet(merged).write.mode("overwrite").parquet(f"{self.path}/filters")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def maybe(self, keys: DataFrame) -> DataFrame:
        """Those of the keys (column key, distinct) that the filters let through."""
        k = keys.select("key", self._slot(F.col("key")).alias("slot"))
        return k.join(self.filters(), "slot").where(F.forall(_places(F.col("key")), lambda p: _is_set(F.col("bits"), p))).select("key")

    def stored(self, keys: DataFrame, key: str = "key") -> DataFrame:
        """key: the distinct ones that are stored."""
        own = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        may = landed(self.maybe(own), "maybe-stored")
        few = [r["key"] for r in may.limit(NAMED_KEYS + 1).collect()]
        if len(few) <= NAMED_KEYS:
            return self.table().where(F.col("key").isin(few)).distinct() if few else may
        return self.table().join(may, "key", "left_semi").distinct()
