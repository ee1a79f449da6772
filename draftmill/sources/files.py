"""File sources: mail as JSON lines, page images as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftmill.functions import scalars, validation

MAIL = "uid STRING, sender STRING, subject STRING, received STRING, message_id STRING, attachments ARRAY<STRUCT<filename: STRING, content_type: STRING>>"


def mail(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MAIL).json(path)


def attachments(messages: DataFrame) -> DataFrame:
    """One row a usable attachment, with the name it is saved under; messages without any drop out."""
    rows = messages.select("*", F.explode("attachments").alias("a")).drop("attachments")
    rows = rows.where(validation.is_attachment(F.col("a.content_type"), F.col("a.filename")))
    stem = F.regexp_replace("a.filename", r"\.[^.]+$", "")
    saved = F.concat(F.date_format(F.try_to_timestamp("received"), "yyyyMMdd_HHmmss"), F.lit("_"), scalars.safe_filename(stem), F.regexp_extract("a.filename", r"(\.[^.]+)$", 1))
    return rows.select("uid", "sender", "subject", "received", F.col("a.filename").alias("filename"), scalars.content_type(F.col("a.filename")).alias("content_type"), saved.alias("saved_as"), scalars.message_ids(F.col("message_id")).alias("message_ids"))


def images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,tif,tiff,pdf}") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def paths_from(value: str | None) -> list[str]:
    """A comma-separated list of paths, trimmed, without blanks."""
    return [p.strip() for p in (value or "").split(",") if p.strip()]


def pages(files: DataFrame, decode: Callable[[bytes], list[tuple[int, int, bytes]]]) -> DataFrame:
    """One row a page, (path, page, height, width, gray); a file that can't be read has none, not some."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    decoded = decode(bytes(content))
                except Exception:  # noqa: BLE001  whatever a decoder raises, the file has no pages
                    decoded = []
                rows += [(path, k, h, w, data) for k, (h, w, data) in enumerate(decoded)]
            yield pd.DataFrame(rows, columns=["path", "page", "height", "width", "gray"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, height int, width int, gray binary")
