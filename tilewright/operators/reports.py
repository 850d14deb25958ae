"""Counts, statistics and comparisons of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def class_counts(df: DataFrame, by: str = "class_name") -> DataFrame:
    """(by, n, share): counts and percent of all, the most frequent first by order of n."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def top_classes(df: DataFrame, n: int = 15, by: str = "class_name") -> DataFrame:
    """The ``n`` most frequent classes with their counts, the most frequent first; ties by name."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def confidence_stats(df: DataFrame, score: str = "confidence") -> DataFrame:
    return df.agg(
        F.min(score).alias("min_conf"), F.avg(score).alias("mean_conf"), F.median(score).alias("median_conf"), F.max(score).alias("max_conf")
    )


def threshold_sweep(df: DataFrame, thresholds: list[float], score: str = "confidence", by: str = "class_name") -> DataFrame:
    """(threshold, detections, mean_confidence, unique_classes) of the rows at or above each threshold; 0 where none are.

    One pass: a row is counted at the highest threshold it reaches, by class,
    and these few counts are added up for the thresholds below.
    """
    own = sorted(thresholds)
    level = F.size(F.filter(F.array(*[F.lit(float(t)) for t in own]), lambda t: t <= F.col(score)))
    seen = df.groupBy(level.alias("level"), by).agg(F.count("*").alias("n"), F.sum(score).alias("s")).where("level > 0")
    each = seen.select(F.explode(F.sequence(F.lit(1), F.col("level"))).alias("at"), by, "n", "s")
    sums = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count_distinct(by).alias("u"))
    all_ = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(own)], "k int, threshold double")
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    return F.broadcast(all_).join(sums, F.col("k") == F.col("at"), "left").select(
        "threshold",
        c("n").cast("bigint").alias("detections"),
        F.coalesce(F.try_divide(F.col("s"), F.col("n")), F.lit(0.0)).alias("mean_confidence"),
        c("u").cast("bigint").alias("unique_classes"),
    )


def change_report(before: DataFrame, after: DataFrame, by: str = "class_name") -> DataFrame:
    """(by, before, after, change, pct) of two counts by class; pct is new, -- or a signed percentage."""
    b = before.groupBy(by).agg(F.count("*").alias("before"))
    a = after.groupBy(by).agg(F.count("*").alias("after"))
    both = b.join(a, by, "full_outer").select(by, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    change = F.col("after") - F.col("before")
    share = F.format_string("%+.1f%%", F.try_divide(change * 100.0, F.col("before")))
    pct = F.when(F.col("before") > 0, share).when(F.col("after") > 0, "new").otherwise("--")
    return both.select(by, "before", "after", change.alias("change"), pct.alias("pct"))


def per_class(df: DataFrame, by: str = "class_name") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg("area_m2").alias("mean_area"), F.avg("confidence").alias("mean_confidence"))


def total_bounds(df: DataFrame) -> DataFrame:
    """The least box around all boxes, its centre and the zoom that maps begin with."""
    sides = df.agg(F.min("x1").alias("min_x"), F.min("y1").alias("min_y"), F.max("x2").alias("max_x"), F.max("y2").alias("max_y"))
    return sides.select(
        "*", ((F.col("min_x") + F.col("max_x")) / 2).alias("centre_x"), ((F.col("min_y") + F.col("max_y")) / 2).alias("centre_y"), F.lit(15).alias("zoom")
    )


def batch_summary(files: DataFrame) -> DataFrame:
    """Totals over (path, detections, seconds); a file that failed has -1 detections."""
    good = F.col("detections") >= 0
    return files.agg(
        F.count("*").alias("files"),
        F.count_if(good).alias("succeeded"),
        F.count_if(~good).alias("failed"),
        F.sum(F.when(good, F.col("detections"))).alias("detections"),
        F.sum(F.when(good, F.col("seconds"))).alias("seconds"),
    )


def coverage_km2(width: Column, height: Column, gsd_m: Column) -> Column:
    return (width * gsd_m) * (height * gsd_m) / 1e6
