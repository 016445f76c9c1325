"""Versioned documents and their workflow, as set operations over events and versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.operators import ranges


def latest(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each group under ``order``, which must decide every tie."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_k = 1").drop("_k")


def audit_events(events: DataFrame, by: str, order: Sequence[Column], only: object = None) -> DataFrame:
    """Every event, or those of the encounter ``only``, with its rank within its encounter under ``order``, which must decide every tie. An encounter may have any number of events."""
    return ranges.ranked(events if only is None else events.where(F.col(by) == F.lit(only)), by, order)


def lookup(df: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the wanted keys, keys without a row)."""
    return df.join(keys, key), keys.join(df.select(key), key, "left_anti")


def illegal_transitions(steps: DataFrame, transitions: Sequence[tuple[str, str]] = K.TRANSITIONS) -> DataFrame:
    """Steps (from_status, to_status and others) that the transition table does not allow."""
    table = steps.sparkSession.createDataFrame(list(transitions), "from_status string, to_status string")
    return steps.join(F.broadcast(table), ["from_status", "to_status"], "left_anti")  # a table of fixed size


def guard_events(events: DataFrame, by: str, order: Sequence[str], status: str, transitions: Sequence[tuple[str, str]] = K.TRANSITIONS, initial: Sequence[str] = K.INITIAL) -> DataFrame:
    """Each event with the state it meets (from_status), whether it is accepted, and the state after it; see ranges.guarded."""
    return ranges.guarded(events, by, [F.col(c) for c in order], status, transitions, initial)


def refused(guarded: DataFrame, status: str) -> DataFrame:
    """The events of guard_events that the state they met does not allow, with from_status (null before the first accepted one) and to_status."""
    return guarded.where("NOT accepted").drop("accepted", "state").withColumnRenamed(status, "to_status")


def fold_status(guarded: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The state that each group of guard_events ends with, since when (null if nothing was accepted), and how many events it had and refused; the events are the source of truth."""
    last = F.max(F.when(F.col("accepted"), F.struct(*order, "state"))).alias("_l")
    return guarded.groupBy(by).agg(last, F.count("*").alias("n_events"), F.count_if(~F.col("accepted")).alias("n_refused")).select(by, F.col("_l.state").alias("status"), F.col(f"_l.{order[0]}").alias("since"), "n_events", "n_refused")


def edit(versions: DataFrame, edits: DataFrame, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(versions after the edits, rejected edits).

    An edit (document, expected_version, payload) is accepted if it names the document's latest version. A draft is edited in
    place; an approved version is never changed: it is cloned as a draft with the next number, which carries its other columns.
    """
    newest = latest(versions, document, [F.col("version_number").desc()])
    asked = edits.select(document, "expected_version", F.col("payload").alias("_new"))
    met = newest.join(asked, document)
    right = F.col("version_number") == F.col("expected_version")
    rejected = edits.join(met.where(right).select(document, "expected_version"), [document, "expected_version"], "left_anti")
    good = met.where(right)
    clones = good.where("status = 'approved'").withColumns({"version_number": F.col("version_number") + 1, "status": F.lit("draft"), "payload": F.col("_new")}).select(*versions.columns)
    drafts = good.where("status = 'draft'").select(document, "version_number", "_new")
    kept = versions.join(drafts, [document, "version_number"], "left").withColumn("payload", F.coalesce("_new", "payload")).select(*versions.columns)
    return kept.unionByName(clones), rejected


def approve(versions: DataFrame, approvals: DataFrame, document: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """(versions after the approvals, rejected approvals): the expected version must be the document's latest and a draft."""
    newest = latest(versions, document, [F.col("version_number").desc()]).where("status = 'draft'").select(document, F.col("version_number").alias("expected_version"))
    good = approvals.join(newest, [document, "expected_version"])
    rejected = approvals.join(newest, [document, "expected_version"], "left_anti")
    marks = good.select(document, F.col("expected_version").alias("version_number"), F.lit(True).alias("_ok"))
    out = versions.join(marks, [document, "version_number"], "left").withColumn("status", F.when(F.col("_ok"), "approved").otherwise(F.col("status")))
    return out.select(*versions.columns), rejected


def public_view(encounters: DataFrame, versions: DataFrame) -> DataFrame:
    """What a token shows: the payload of the approved version of a published encounter, nothing else."""
    live = encounters.where("status = 'PUBLISHED' AND public_token IS NOT NULL").select("public_token", F.col("approved_version_id").alias("version_id"))
    return live.join(versions, "version_id").select("public_token", "payload")


def detail_view(encounters: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Encounters with their draft, approved version and latest run that is not complete."""
    v = lambda name: versions.select(F.col("version_id").alias(f"{name}_version_id"), F.col("payload").alias(f"{name}_payload"))
    active = latest(runs.where("status <> 'COMPLETED'"), "encounter_id", [F.col("created_at").desc(), F.col("run_id")]).select("encounter_id", F.col("run_id").alias("active_run_id"))
    return encounters.join(v("draft"), "draft_version_id", "left").join(v("approved"), "approved_version_id", "left").join(active, "encounter_id", "left")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key is set and has no parent."""
    return child.where(F.col(child_key).isNotNull()).join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def repeated_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def audio_problem(df: DataFrame) -> DataFrame:
    """With ``problem``: too_large, format, too_long or null. A file is refused for its format only if both container and codec are unknown."""
    formats, codecs = F.array(*map(F.lit, ("wav", "mp3", "mov", "mp4", "m4a", "ogg", "webm", "matroska", "flac"))), ("pcm_s16le", "mp3", "aac", "opus", "vorbis", "flac")
    known = F.arrays_overlap(F.transform(F.split("format", ","), lambda x: F.trim(x)), formats) | F.coalesce(F.col("codec").isin(*codecs), F.lit(False))
    problem = F.when(F.col("size_bytes") > K.MAX_UPLOAD_BYTES, "too_large").when(~F.coalesce(known, F.lit(False)), "format").when(F.col("duration_seconds") > K.MAX_AUDIO_SECONDS, "too_long")
    return df.withColumn("problem", problem)


def probe_duration(format_seconds: Column, stream_seconds: Column, ticks: Column, num: Column, den: Column) -> Column:
    """The first positive of the container's duration, the stream's, and ticks by time base."""
    positive = lambda x: F.when(x > 0, x)
    return F.coalesce(positive(format_seconds), positive(stream_seconds), positive(F.try_divide(ticks * num, den)))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``; empty if both hold the same bag of rows."""
    columns = left.columns
    right = right.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def manifest_cases(manifest: DataFrame, enrolled: DataFrame, by: str = "doctor") -> DataFrame:
    """Cases of a manifest with ``state``: RUN where the doctor is enrolled, SKIPPED otherwise."""
    known = enrolled.select(by).distinct().withColumn("_known", F.lit(True))
    return manifest.join(known, by, "left").withColumn("state", F.when(F.col("_known"), "RUN").otherwise("SKIPPED")).drop("_known")


def shift_turns(turns: DataFrame, offset_ms: int, duration_ms: Column) -> DataFrame:
    """Turns of a clip that is mixed in from ``offset_ms`` on: shifted, cut at the end of the recording, dropped beyond it."""
    start, end = F.col("start_ms") + offset_ms, F.least(F.col("end_ms") + offset_ms, duration_ms)
    return turns.where(start < duration_ms).withColumns({"start_ms": start, "end_ms": end})


def finding_text(raw: Column, trigger: Column) -> Column:
    return F.coalesce(F.nullif(raw, F.lit("")), trigger)
