"""Helpers shared by the operators: table access and shared work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, newline, vertical tab, form feed, return.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder; any
    other master is an error, since its executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="draftmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/draftmill/{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and returns the table read back.

    This cuts lineage: a lost executor never makes an earlier step run again.
    """
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores at least: a small table may be a single file of one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def drop(*tables: DataFrame) -> None:
    """Deletes what ``save`` stored for these tables, which nothing may read any more."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/draftmill/" in path:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with those of df, whatever it carries."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"_dm_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a unique row locator, the file's path and the row's number there, which any later scan gives again.

    A frame that isn't a scan of Parquet files is stored first.
    """
    (row,) = free_name(docs, "row")

    def located(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("at")).alias(row))

    try:
        return located(docs), row
    except AnalysisException:  # no such metadata
        return located(save(docs, "rows")), row


#: Of all rows, a key that holds more than this share is hot: there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1024


def meet(rows: DataFrame, table: DataFrame, key: str, weight: str, how: str = "left") -> DataFrame:
    """rows joined to a table of one row a key, nulls included, without sending a hot key's rows to one task.

    ``weight`` is the number of rows of a key.  Keys over ``HOT_SHARE`` of all
    rows, whose number is bounded by that, are broadcast; the others are
    shuffled.  The table is stored, as it is read several times, and the weight
    is left out of the result.
    """
    table = save(table, "meet")
    (theirs,) = free_name(rows, "key")
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > total * HOT_SHARE
    light, heavy = (table.where(c).drop(weight).withColumnRenamed(key, theirs) for c in (~hot, hot))
    same = rows[key].eqNullSafe(F.col(theirs))
    few = [r[0] for r in heavy.select(theirs).collect()]
    is_hot = F.lit(False)
    if few:
        is_hot = F.coalesce(F.col(key).isin([k for k in few if k is not None]), F.lit(None in few))
    quick = rows.where(is_hot).join(F.broadcast(heavy), same, how).drop(theirs)
    slow = rows.where(~is_hot).join(light, same, how).drop(theirs)
    return quick.unionByName(slow) if few else slow
