"""A store laid out for lookups: rows by hash of the key into files of few keys, with a base and the batches after it.

A key's bucket is told by its hash, so a lookup reads one folder of the base and
of each batch, and within a file the rows are sorted by key, with a bloom filter,
so that most row groups are left out.  Batches are appended; compaction merges
them into a new base, of which only buckets with new rows are written anew.  The
base is named by a manifest that is written last, so a reader sees the old base
or the new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftmill.sources import workdir


def bucket_of(keys: tuple[Column, ...], buckets: int) -> Column:
    """The bucket of a key; rows of a key with nulls share one."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Store:
    """A table of latest rows by key: ``version`` says which of two rows of a key counts, the greater."""

    path: str
    schema: StructType
    keys: tuple[str, ...]
    version: str
    buckets: int = 64

    def _laid(self, rows: DataFrame) -> DataFrame:
        key = bucket_of(tuple(F.col(k) for k in self.keys), self.buckets)
        return rows.select(self.schema.fieldNames()).withColumn("bucket", key).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys)

    def _put(self, rows: DataFrame, path: str) -> None:
        out = rows.write.mode("overwrite").partitionBy("bucket")
        for k in self.keys:
            out = out.option(f"parquet.bloom.filter.enabled#{k}", "true")
        out.parquet(path)

    def append(self, rows: DataFrame, number: int) -> None:
        """Adds a batch; one that is added again replaces itself."""
        self._put(self._laid(rows), f"{self.path}/deltas/batch={number}")

    def _bases(self, spark: SparkSession) -> dict[int, tuple[int, int]]:
        """By bucket, the base that has it and the last batch in that; from the newest manifest."""
        found = workdir.batches(spark, f"{self.path}/manifests")
        done = [n for n in found if workdir.exists(spark, f"{self.path}/manifests/batch={n}/_SUCCESS")]
        if not done:
            return {}
        return {r["bucket"]: (r["base"], r["upto"]) for r in spark.read.parquet(f"{self.path}/manifests/batch={done[-1]}").collect()}  # a row a bucket

    def _folders(self, spark: SparkSession, only: list[int] | None = None, before: int | None = None) -> list[str]:
        """The folders that hold what counts, of some buckets or of all, as it was before a batch or as it is."""
        bases, out = self._bases(spark), []
        upto = max((u for _, u in bases.values()), default=-1)
        for b in range(self.buckets) if only is None else only:
            if b in bases:
                out.append(f"{self.path}/bases/batch={bases[b][0]}/bucket={b}")
            for n in workdir.batches(spark, f"{self.path}/deltas"):
                if n > upto and (before is None or n < before):
                    out.append(f"{self.path}/deltas/batch={n}/bucket={b}")
        return [f for f in out if workdir.exists(spark, f)]

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*folders) if folders else spark.createDataFrame([], self.schema)

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = self.schema.fieldNames()
        rest = F.struct(*(c for c in names if c not in self.keys))
        return rows.groupBy(*self.keys).agg(F.max_by(rest, self.version).alias("r")).select(*(c if c in self.keys else f"r.{c}" for c in names))

    def read(self, spark: SparkSession) -> DataFrame:
        """The latest row of each key."""
        return self._latest(self._read(spark, self._folders(spark)))

    def lookup(self, spark: SparkSession, *values: object) -> DataFrame:
        """The latest row of one key, from its bucket alone; the filter reaches the files."""
        types = [self.schema[k].dataType for k in self.keys]
        literals = tuple(F.lit(v).cast(t) for v, t in zip(values, types, strict=True))
        bucket = spark.range(1).select(bucket_of(literals, self.buckets)).first()[0]
        rows = self._read(spark, self._folders(spark, [bucket]))
        for k, v in zip(self.keys, literals, strict=True):
            rows = rows.where(F.col(k) == v)
        return self._latest(rows)

    def known(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """What the store has of the rows' keys, now or before a batch that is not compacted yet: only buckets that the rows touch are read."""
        spark = rows.sparkSession
        key = bucket_of(tuple(F.col(k) for k in self.keys), self.buckets)
        touched = [r[0] for r in rows.select(key.alias("b")).distinct().collect()]  # at most one row a bucket
        wanted = rows.select(*self.keys).dropna().distinct()
        return self._latest(self._read(spark, self._folders(spark, touched, before)).join(wanted, list(self.keys), "left_semi"))

    def compact(self, spark: SparkSession) -> int:
        """Merges base and batches; gives how many buckets were written anew.  What no manifest names any more goes, all but the base before."""
        bases, upto = self._bases(spark), -1
        upto = max((u for _, u in bases.values()), default=-1)
        fresh = [n for n in workdir.batches(spark, f"{self.path}/deltas") if n > upto]
        if not fresh:
            return 0
        new = {int(f.removeprefix("bucket=")) for n in fresh for f in workdir.folders(spark, f"{self.path}/deltas/batch={n}") if f.startswith("bucket=")}
        number = fresh[-1]
        if new:
            merged = self._latest(self._read(spark, self._folders(spark, sorted(new))))
            self._put(self._laid(merged), f"{self.path}/bases/batch={number}")
        manifest = {b: (base, number) for b, (base, _) in bases.items()} | {b: (number, number) for b in new}
        rows = [(b, base, last) for b, (base, last) in sorted(manifest.items())]
        spark.createDataFrame(rows, "bucket int, base int, upto int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/batch={number}")
        named = {base for base, _ in manifest.values()} | {base for base, _ in bases.values()}
        for old in workdir.batches(spark, f"{self.path}/bases"):
            if old not in named:
                workdir.remove(spark, f"{self.path}/bases/batch={old}")
        for old in workdir.batches(spark, f"{self.path}/deltas"):
            if old <= upto:  # in the base before this one, which readers may still use
                workdir.remove(spark, f"{self.path}/deltas/batch={old}")
        return len(new)
