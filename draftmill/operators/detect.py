"""Finds checks on scanned pages from their connected components, as one relational plan.

Everything is keyed by page, so the page's hash partitioning serves all windows
after one shuffle.  Rows of a page are bounded by what fits on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    """Fixed values of the detector: sizes in pixels at 300 dpi, shares in percent."""

    width: int = 2550
    height: int = 6000
    least_area: int = 80
    iqr_factor: float = 1.5
    z_limit: float = 2.5
    expand_percent: float = 4.0
    least_width: int = 300
    strip_height: int = 450
    strip_gap: int = 600
    base_confidence: int = 50
    margin: int = 40


def usable(components: DataFrame, p: Detector = Detector()) -> DataFrame:
    """Components off the border and of some size."""
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") + F.col("w") == p.width) | (F.col("y") + F.col("h") == p.height)
    return components.where(~border & (F.col("area") >= p.least_area))


def groups(components: DataFrame, p: Detector = Detector()) -> DataFrame:
    """Usable components with ``grp``, split at large vertical gaps."""
    by_y = Window.partitionBy("page").orderBy("cy", "label")
    rows = usable(components, p).withColumn("gap", F.lead("y").over(by_y) - (F.col("y") + F.col("h")))
    positive = rows.where("gap > 0").groupBy("page").agg(F.percentile("gap", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    limit = positive.select("page", (F.col("q")[1] + F.lit(p.iqr_factor) * (F.col("q")[2] - F.col("q")[0])).alias("limit"))
    rows = rows.join(limit, "page", "left").withColumn("cut", F.coalesce((F.col("gap") > 0) & (F.col("gap") >= F.col("limit")), F.lit(False)))
    # Without such a gap, the first of the largest positive gaps parts the page.
    widest = Window.partitionBy("page").orderBy(F.when(F.col("gap") > 0, F.col("gap")).desc_nulls_last(), "cy", "label")
    page = Window.partitionBy("page")
    rows = rows.withColumns({"any_cut": F.max("cut").over(page), "rank": F.row_number().over(widest)})
    rows = rows.withColumn("cut", F.when(F.col("any_cut"), F.col("cut")).otherwise(F.coalesce(F.col("gap") > 0, F.lit(False)) & (F.col("rank") == 1)))
    earlier = by_y.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("grp", F.coalesce(F.sum(F.col("cut").cast("int")).over(earlier), F.lit(0))).drop("any_cut", "rank", "limit")


def merge_strips(grouped: DataFrame, p: Detector = Detector()) -> DataFrame:
    """Joins a low group to the one above it.

    Whether a pair may merge depends on the two groups alone, and merging goes
    down the page in pairs without cascading: within each run of mergeable
    pairs, every second one merges.
    """
    box = grouped.groupBy("page", "grp").agg(F.min("y").alias("top"), F.max(F.col("y") + F.col("h")).alias("bottom"))
    order = Window.partitionBy("page").orderBy("grp")
    next_height, next_gap = F.lead(F.col("bottom") - F.col("top")).over(order), F.lead("top").over(order) - F.col("bottom")
    box = box.withColumn("may", F.coalesce((next_height < p.strip_height) & (next_gap < p.strip_gap), F.lit(False)))
    box = box.withColumn("run", F.sum((~F.col("may")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    in_run = Window.partitionBy("page", F.coalesce("run", F.lit(0))).orderBy("grp")
    box = box.withColumn("at", F.row_number().over(in_run) - 1).withColumn("merges", F.col("may") & (F.col("at") % 2 == 0))
    box = box.withColumn("into", F.when(F.coalesce(F.lag("merges").over(order), F.lit(False)), F.col("grp") - 1).otherwise(F.col("grp")))
    return grouped.join(box.select("page", "grp", "into"), ["page", "grp"]).drop("grp").withColumnRenamed("into", "grp")


def boxes(grouped: DataFrame, p: Detector = Detector()) -> DataFrame:
    """Outliers out, boxes around what stays, widened, narrow ones dropped."""
    g = Window.partitionBy("page", "grp")
    z = F.abs(F.col("cy") - F.avg("cy").over(g)) / (F.stddev_pop("cy").over(g) + F.lit(1e-10))
    rows = grouped.withColumn("keep", z <= p.z_limit).withColumn("some", F.max("keep").over(g)).withColumn("used", F.col("keep") | ~F.col("some"))
    box = rows.groupBy("page", "grp").agg(
        F.min(F.when(F.col("used"), F.col("x"))).alias("x0"),
        F.min(F.when(F.col("used"), F.col("y"))).alias("y0"),
        F.max(F.when(F.col("used"), F.col("x") + F.col("w"))).alias("x1"),
        F.max(F.when(F.col("used"), F.col("y") + F.col("h"))).alias("y1"),
        F.count_if("used").alias("components_used"),
        F.count_if(~F.col("used")).alias("outliers_removed"),
    )
    share = p.expand_percent / 100.0
    dx, dy = F.floor((F.col("x1") - F.col("x0")) * F.lit(share)), F.floor((F.col("y1") - F.col("y0")) * F.lit(share))
    box = box.withColumns({"dx": dx, "dy": dy}).select(
        "page",
        "grp",
        F.greatest(F.lit(0), F.col("x0") - F.col("dx")).alias("x"),
        F.greatest(F.lit(0), F.col("y0") - F.col("dy")).alias("y"),
        F.least(F.lit(p.width), F.col("x1") + F.col("dx")).alias("right"),
        F.least(F.lit(p.height), F.col("y1") + F.col("dy")).alias("bottom"),
        "components_used",
        "outliers_removed",
    )
    return box.where(F.col("right") - F.col("x") >= p.least_width)


def trim_overlap(box: DataFrame, p: Detector = Detector()) -> DataFrame:
    """Each box starts below the one above it; bottoms never move, so the row above is all it takes."""
    order = Window.partitionBy("page").orderBy("y", "grp")
    above = F.lag("bottom").over(order) + p.margin
    top = F.when(above.isNull(), F.col("y")).otherwise(F.least(F.greatest(F.col("y"), above), F.col("bottom") - 1))
    return box.withColumns({"det": F.row_number().over(order) - 1, "top": top})


def detect(components: DataFrame, p: Detector = Detector()) -> DataFrame:
    """One row a detected check: page, det, box, confidence and counts."""
    box = trim_overlap(boxes(merge_strips(groups(components, p), p), p), p)
    width, height = F.col("right") - F.col("x"), F.col("bottom") - F.col("top")
    return box.select(
        "page",
        F.col("det").cast("int").alias("det"),
        F.col("x").cast("long").alias("x"),
        F.col("top").cast("long").alias("y"),
        width.cast("long").alias("w"),
        height.cast("long").alias("h"),
        F.least(F.lit(100.0), F.lit(float(p.base_confidence)) + F.col("components_used") / 10.0).alias("confidence"),
        F.col("components_used").cast("long").alias("components_used"),
        F.col("outliers_removed").cast("long").alias("outliers_removed"),
    )
