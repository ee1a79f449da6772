"""Folders for what a job stores on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which driver and executors share; a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="draftmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/draftmill/{label}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    files, where = _at(spark, path)
    goal = spark._jvm.org.apache.hadoop.fs.Path(to)
    files.mkdirs(goal.getParent())
    files.rename(where, goal)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none if it is not there."""
    files, where = _at(spark, path)
    return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that a table's folder holds."""
    return sorted(int(n.removeprefix("batch=")) for n in folders(spark, path) if n.startswith("batch="))
