"""From raw submissions to routes, and from routes to batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftmill.functions import scalars
from draftmill.operators import dedup, scoring
from draftmill.plans.settings import Settings

ROUTES = ("failed", "duplicate", "manual_review", "processed")


def judge(raw: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """Scores, ages, flags, review reasons, duplicates and the route of each submission; raw is read twice, for its keys."""
    return dedup.mark_duplicates(judge_alone(raw, as_of, settings), keys=raw).withColumn("route", route())


def judge_alone(raw: DataFrame, as_of: str, settings: Settings = Settings()) -> DataFrame:
    """What a submission's own fields tell: all but duplicates and the route."""
    df = scoring.with_scores(raw)
    df = scoring.with_age(df, F.lit(as_of).cast("date"), scalars.any_date(F.col("check_date")), settings.stale_days)
    df = df.withColumn("flagged", scoring.review_flag(settings.prompt_confidence, settings.field_confidence))
    return df.withColumn("review_reason", scoring.review_reason(settings.review_confidence))


def route() -> Column:
    """failed before duplicate before manual review before processed."""
    return F.when(F.col("error").isNotNull(), "failed").when(F.col("is_duplicate"), "duplicate").when(F.col("review_reason").isNotNull(), "manual_review").otherwise("processed")


def destination(route: Column, settings: Settings = Settings()) -> Column:
    return F.when(route == "failed", settings.failed_folder).when(route == "processed", settings.processed_folder).otherwise(settings.review_folder)


def batch_items(judged: DataFrame) -> DataFrame:
    """Numbers the items of each file over all its pages, from 0."""
    w = Window.partitionBy("file").orderBy("page", "rid")  # a file's own items
    return judged.withColumn("item", F.row_number().over(w) - 1)


def batch_outcome(judged: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per file: items that succeeded (of any route but failed) and failed, and the folder for its mail."""
    failed = F.count_if(F.col("route") == "failed")
    done = judged.groupBy("file").agg(F.count("*").alias("items"), (F.count("*") - failed).alias("succeeded"), failed.alias("failed"))
    return done.withColumn("folder", folder(settings))


def folder(settings: Settings = Settings()) -> Column:
    """Where a mail goes by how many of its items failed and succeeded."""
    return F.when(F.col("failed") == 0, settings.processed_folder).when(F.col("succeeded") == 0, settings.failed_folder).otherwise(settings.review_folder)


def work_units(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """One unit a detection, numbered from 0 on its page, or the full page where there is none; with the scenario of the file."""
    units = pages.join(detections, "page", "left").withColumn("used_detection", F.col("det").isNotNull())
    file = Window.partitionBy("file")  # a file's own pages
    n_pages, found = F.sum(F.when(F.coalesce("det", F.lit(0)) == 0, 1)).over(file), F.count("det").over(file)
    scenario = F.when(n_pages > 1, "multi_page").when(found == 0, "full_page").when(found == 1, "single_crop").otherwise("multi_check")
    return units.withColumn("scenario", scenario)
