"""Alignment of timelines: best overlap with a nearest fallback, text by overlap, speaker mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the bins that bring overlapping intervals of one key together.
BIN_MS = 60_000


def _overlap(a: str, b: str):
    return F.least(f"{a}.end_ms", f"{b}.end_ms") - F.greatest(f"{a}.start_ms", f"{b}.start_ms")


def _binned(df: DataFrame) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.expr(f"sequence(start_ms div {BIN_MS}, greatest(start_ms, end_ms - 1) div {BIN_MS})")))


def overlapping(left: DataFrame, right: DataFrame, key: str = "conv_id") -> DataFrame:
    """Pairs (as l and r) of one key whose intervals overlap, each once: an equi-join on key and time bin, in the bin where the overlap begins."""
    on = (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col("l._bin") == F.col("r._bin")) & (_overlap("l", "r") > 0)
    first = F.col("l._bin") == F.floor(F.greatest("l.start_ms", "r.start_ms") / BIN_MS)
    return _binned(left).alias("l").join(_binned(right).alias("r"), on & first)


def best_overlap(segments: DataFrame, turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each segment (key, seg, start_ms, end_ms) with the turn (key, turn, start_ms, end_ms, speaker_index) that it overlaps most, the first of equals.

    A segment without any overlap gets the turn that starts nearest, the first of equals. Segments of keys without turns are left out.
    """
    top = F.max(F.struct(_overlap("l", "r").alias("ms"), (-F.col("r.turn")).alias("turn"), F.col("r.speaker_index").alias("speaker_index")))
    best = overlapping(segments, turns, key).groupBy(F.col(f"l.{key}").alias(key), F.col("l.seg").alias("seg")).agg(top.alias("_b"))
    best = best.select(key, "seg", (-F.col("_b.turn")).alias("turn"), F.col("_b.speaker_index").alias("speaker_index"), F.col("_b.ms").alias("overlap_ms"))
    # nearest start: turns and the segments without overlap on one time line, at equal times the turns first and of those the first turn last
    alone = segments.join(best.select(key, "seg"), [key, "seg"], "left_anti").select(key, F.col("start_ms").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("o"), "seg", F.lit(None).cast("struct<at:bigint,turn:bigint,speaker_index:bigint>").alias("t"))
    t = F.struct(F.col("start_ms").alias("at"), F.col("turn").cast("long").alias("turn"), F.col("speaker_index").cast("long").alias("speaker_index"))
    line = turns.select(key, F.col("start_ms").alias("at"), F.lit(0).alias("kind"), (-F.col("turn")).cast("long").alias("o"), F.lit(None).cast(segments.schema["seg"].dataType).alias("seg"), t.alias("t")).unionByName(alone)
    w = Window.partitionBy(key).orderBy("at", "kind", "o")
    before = F.last("t", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("t", ignorenulls=True).over(Window.partitionBy(key).orderBy("at", "kind", F.col("o").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    away = lambda x: F.when(x.isNotNull(), F.struct(F.abs(x["at"] - F.col("at")).alias("ms"), x["turn"].alias("turn"), x["speaker_index"].alias("speaker_index")))
    near = line.select(key, "seg", "at", "kind", before.alias("b"), after.alias("a")).where("kind = 1")
    near = near.withColumn("_n", F.array_min(F.array_compact(F.array(away(F.col("b")), away(F.col("a")))))).where("_n IS NOT NULL")
    return best.unionByName(near.select(key, "seg", F.col("_n.turn").alias("turn"), F.col("_n.speaker_index").alias("speaker_index"), F.lit(0).cast("long").alias("overlap_ms")))


def text_by_overlap(truth: DataFrame, predicted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each true segment with the texts of all predictions that overlap it, by start, and the speaker of the longest overlap, the first of equals."""
    item = F.struct(F.col("r.start_ms"), F.col("r.turn"), F.col("r.text"))
    top = F.max(F.struct(_overlap("l", "r").alias("o"), (-F.col("r.start_ms")).alias("s"), (-F.col("r.turn")).alias("t"), F.col("r.speaker_index").alias("speaker")))
    df = overlapping(truth, predicted, key).groupBy(F.col(f"l.{key}").alias(key), F.col("l.turn").alias("turn")).agg(
        F.sort_array(F.collect_list(item)).alias("_p"), top["speaker"].alias("speaker_index"), F.count("*").alias("n_overlaps")
    )
    df = truth.select(key, "turn").join(df, [key, "turn"], "left")
    text = F.coalesce(F.array_join(F.transform("_p", lambda x: x["text"]), " "), F.lit(""))
    return df.select(key, "turn", text.alias("matched_text"), "speaker_index", F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"))


def speaker_mapping_accuracy(truth: DataFrame, predicted: DataFrame, key: str = "conv_id") -> DataFrame:
    """Share of true segments whose dominant predicted speaker maps to their own; a predicted speaker maps to the true one it overlaps longest."""
    shared = overlapping(truth, predicted, key)
    sums = shared.groupBy(F.col(f"l.{key}").alias(key), F.col("r.speaker_index").alias("pred"), F.col("l.speaker_index").alias("gt")).agg(F.sum(_overlap("l", "r")).alias("ms"))
    top = F.max(F.struct(F.col("ms"), (-F.col("gt")).alias("gt")))
    mapped = sums.groupBy(key, "pred").agg(top.alias("_t")).select(key, "pred", (-F.col("_t.gt")).alias("mapped"))
    dominant = text_by_overlap(truth, predicted, key).select(key, "turn", F.col("speaker_index").alias("pred")).where("pred IS NOT NULL")
    checked = dominant.join(mapped, [key, "pred"]).join(truth.select(key, "turn", F.col("speaker_index").alias("gt")), [key, "turn"])
    return checked.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("mapped") == F.col("gt")).alias("correct")).withColumn("accuracy", F.col("correct") / F.col("total"))
