"""Stage latencies, real-time factors, speedups and utilization from telemetry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.operators import ranges


#: Bins of the histogram that finds where a median lies, for each factor of e.
BINS = 4096


def exact_median(df: DataFrame, by: str, value: str, bins: int = BINS) -> DataFrame:
    """(by, median) of the values that are not null; rows without ``by`` have no median.

    Equal values are counted before they are shuffled. A histogram of bins whose width grows with the value tells which bins hold the two
    middle ranks, and only the values of those are sorted, so no task holds all values of a group. Bins need neither the least nor the greatest
    value, so the input is read once, and an outlier does not widen them.
    """
    v = F.col("v")
    counts = df.where(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    place = F.when(F.isnan(v), F.lit((1 << 63) - 1)).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * bins))
    binned = counts.withColumn("bin", place)
    sizes = binned.groupBy(by, "bin").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(by).orderBy("bin")) - F.col("size")).withColumn("total", F.sum("size").over(Window.partitionBy(by)))
    low, high = F.expr("(total - 1) div 2"), F.expr("total div 2")
    middle = sizes.where((F.col("before") <= high) & (F.col("before") + F.col("size") > low)).select(by, "bin", "before", "total")
    upto = F.col("before") + F.sum("n").over(Window.partitionBy(by, "bin").orderBy("v"))
    values = binned.join(middle, [by, "bin"]).withColumn("upto", upto).where((F.col("upto") > low) & (F.col("upto") - F.col("n") <= high))
    return values.groupBy(by).agg(((F.min("v") + F.max("v")) / 2).alias("median"))


def stage_latency(warm: DataFrame, cold: DataFrame, stage: str = "stage", ms: str = "duration_ms") -> DataFrame:
    """Per stage: median, least and greatest of the warm runs and the last cold value; stages of either side are listed. ``cold`` has an ord."""
    w = warm.groupBy(stage).agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count("*").alias("n_warm"))
    w = w.join(exact_median(warm, stage, ms).withColumnRenamed("median", "median_ms"), stage, "left")
    c = cold.groupBy(stage).agg(F.max(F.struct("ord", ms))[ms].alias("cold_ms"))
    return w.join(c, stage, "full")


def real_time_factor(total_ms: Column, audio_seconds: Column) -> Column:
    """Processing time by audio time; not a number without audio."""
    return F.coalesce(F.try_divide(total_ms / 1000, audio_seconds), F.lit(float("nan")))


def parallel_speedup(tasks: DataFrame, by: str, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Per group of tasks: wall and sequential time, time in which all overlap, speedup, and whether it is worth it."""
    df = tasks.groupBy(by).agg(
        (F.max(end) - F.min(start)).alias("wall_ms"), F.sum(F.col(end) - F.col(start)).alias("sequential_ms"), F.greatest(F.lit(0), F.min(end) - F.max(start)).alias("overlap_ms")
    )
    ratio = F.try_divide("sequential_ms", "wall_ms")
    return df.withColumn("speedup", ratio).withColumn("worth_it", F.coalesce(ratio >= K.SPEEDUP, F.lit(False)))


def counter_deltas(samples: DataFrame, by: str, order: list[str], counter: str) -> DataFrame:
    """Difference of a counter to the sample before, null for the first. A source may have any number of samples."""
    return ranges.with_previous(samples, by, [F.col(c) for c in order], counter, "_before").withColumn("delta", F.col(counter) - F.col("_before")).drop("_before")


def utilization(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Average and greatest value, to one digit."""
    return samples.groupBy(by).agg(F.round(F.avg(value), 1).alias("avg_value"), F.round(F.max(value), 1).alias("max_value"), F.count(value).alias("n_samples"))


def diagnostics(calls: DataFrame, by: str) -> DataFrame:
    """Per run: seconds of input, calls, and both again for the calls in the one-language mode."""
    only = F.col("mode") == "ko_only"
    return calls.groupBy(by).agg(
        F.sum("input_seconds").alias("input_seconds"), F.count("*").alias("n_calls"), F.count_if(only).alias("n_ko_only"), F.coalesce(F.sum(F.when(only, F.col("input_seconds"))), F.lit(0)).alias("ko_only_seconds")
    )
