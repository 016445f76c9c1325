"""Shaping of speech segments: merging, splitting, labelling and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.text import strip_dashes


def _islands(turns: DataFrame, gap_ms: int, key: str) -> DataFrame:
    """With _island: it rises where the speaker changes or the pause since the previous turn's end reaches ``gap_ms``."""
    w = Window.partitionBy(key).orderBy("start_ms", "turn")
    joined = (F.lag("speaker_index").over(w) == F.col("speaker_index")) & (F.col("start_ms") - F.lag("end_ms").over(w) < gap_ms)
    df = turns.withColumn("_new", F.when(joined, 0).otherwise(1))
    return df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def merge_turns(turns: DataFrame, gap_ms: int = K.TURN_GAP_MS, key: str = "conv_id") -> DataFrame:
    """Adjacent turns of one speaker with shorter pauses as one; it ends where its last turn ends."""
    last = F.max(F.struct("start_ms", "turn", "end_ms"))
    df = _islands(turns, gap_ms, key).groupBy(key, "_island").agg(
        F.min("start_ms").alias("start_ms"), last["end_ms"].alias("end_ms"), F.first("speaker_index").alias("speaker_index"), F.count("*").alias("n_turns")
    )
    return df.withColumn("turn", F.col("_island") - 1).drop("_island").select(key, "turn", "speaker_index", "start_ms", "end_ms", "n_turns")


def split_turns(turns: DataFrame, max_ms: int = K.MAX_TURN_MS, key: str = "conv_id") -> DataFrame:
    """Turns over ``max_ms`` as equal pieces, whole milliseconds."""
    dur = F.col("end_ms") - F.col("start_ms")
    n = F.greatest(F.lit(1).cast("long"), F.ceil(dur / max_ms)).cast("long")
    df = turns.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    edge = lambda k: F.expr(f"start_ms + ((end_ms - start_ms) * (piece + {k})) div _n")
    return df.select(key, "turn", "piece", "speaker_index", edge(0).alias("start_ms"), F.least(edge(1), F.col("end_ms")).alias("end_ms"))


def merge_utterances(rows: DataFrame, gap_ms: int = K.UTTERANCE_GAP_MS, key: str = "conv_id") -> DataFrame:
    """Adjacent rows of one speaker as one utterance, texts joined in order."""
    parts = F.sort_array(F.collect_list(F.struct("start_ms", "turn", strip_dashes(F.col("text")).alias("text"))))
    last = F.max(F.struct("start_ms", "turn", "end_ms"))
    df = _islands(rows, gap_ms, key).groupBy(key, "_island").agg(
        F.min("start_ms").alias("start_ms"), last["end_ms"].alias("end_ms"), F.first("speaker_index").alias("speaker_index"), parts.alias("_p")
    )
    text = F.array_join(F.transform("_p", lambda p: p["text"]), " ")
    return df.select(key, (F.col("_island") - 1).alias("utterance"), "speaker_index", "start_ms", "end_ms", text.alias("text"))


def speaker_letter(index: Column) -> Column:
    return F.char(index + 65)


def label_segments(rows: DataFrame, key: str = "conv_id", order: str = "utterance") -> DataFrame:
    """With a letter for the speaker and an id by order, seg_001 onwards."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", order))
    return rows.withColumn("speaker", speaker_letter(F.col("speaker_index"))).withColumn("segment_id", F.format_string("seg_%03d", n))


def build_transcript(segments: DataFrame, roles: Column, labels: dict[str, str] = K.ROLE_LABELS, key: str = "conv_id") -> DataFrame:
    """One text per key: a line "label: text" for each segment by start. ``roles`` maps a speaker to a role; a speaker without one is unknown."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    label = F.coalesce(names[F.coalesce(roles[F.col("speaker")], F.lit("unknown"))], F.lit(labels["unknown"]))
    line = F.struct("start_ms", "turn", F.concat(label, F.lit(": "), F.col("text")).alias("line"))
    df = segments.groupBy(key).agg(F.sort_array(F.collect_list(line)).alias("_l"))
    return df.select(key, F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("transcript"))
