"""Rows to append to the stores of encounters, versions, runs and telemetry, ordered listings, and guards.

Appended rows are DataFrames; what a write would refuse comes back as a table of its own. Tables
are never changed in place: an update gives the table as it is after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions import constants as K
from skein.operators.workflow import latest
from skein.sources.tables import EXPLANATION, STRUCTURE


def newest_first(df: DataFrame, created: str, key: str) -> DataFrame:
    """All rows, newest first; the key decides ties."""
    return df.orderBy(F.col(created).desc(), F.col(key))


def children(df: DataFrame, parent: str, created: str, key: str, only: object = None) -> DataFrame:
    """Rows of the parent ``only``, or of each parent in turn, oldest first; the key decides ties."""
    if only is not None:
        return df.where(F.col(parent) == F.lit(only)).orderBy(created, key)
    return df.orderBy(parent, created, key)


def stage_runs(df: DataFrame, created: str, key: str, encounter: str, only: object = None) -> DataFrame:
    """The telemetry log, or that of the encounter ``only``, newest first; the key decides ties."""
    return newest_first(df if only is None else df.where(F.col(encounter) == F.lit(only)), created, key)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> bool:
    """Appends rows to a parquet table; without rows it writes nothing, no folder either, and says so."""
    if df.isEmpty():
        return False
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    return True


def append_batch(df: DataFrame, path: str, batch: str) -> None:
    """Appends the rows of a batch to a parquet table, under a column ``batch``; written again, by a retried driver, say, they take the place of what the same batch has left. Other batches stay.

    ``df`` is read once. A batch without rows leaves the table as it is. A column ``batch`` of the input gives way.
    """
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def set_roles(runs: DataFrame, segments: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs after the role maps, audit rows to append, refused requests).

    ``runs`` has run_id, encounter_id, roles (a map) and updated_at, ``segments`` run_id and speaker, ``asked`` run_id, roles and created_at. A request is refused if its run is unknown, its map is null or empty, or it
    names a speaker that the run's segments lack. Of several for a run the last one that is not refused counts, all of these are audited; of equal times the map that comes last as text.
    """
    named = asked.withColumn("_id", F.xxhash64("run_id", F.to_json("roles"), "created_at"))
    speakers = named.where("size(roles) > 0").select("run_id", "_id", F.explode(F.map_keys("roles")).alias("speaker")).distinct()
    strange = speakers.join(segments.select("run_id", "speaker").distinct(), ["run_id", "speaker"], "left_anti").select("run_id", "_id").distinct()
    good = named.where("size(roles) > 0").join(strange, ["run_id", "_id"], "left_anti").join(runs.select("run_id", "encounter_id"), "run_id")
    refused = named.join(good.select("run_id", "_id").distinct(), ["run_id", "_id"], "left_anti").select(*asked.columns)
    last = good.groupBy("run_id").agg(F.max(F.struct("created_at", F.to_json("roles").alias("_json"))).alias("_l"))
    last = last.select("run_id", F.from_json("_l._json", "map<string,string>").alias("_roles"), F.col("_l.created_at").alias("_at"))
    after = runs.join(last, "run_id", "left").withColumns({"roles": F.coalesce("_roles", "roles"), "updated_at": F.coalesce("_at", "updated_at")})
    return after.select(*runs.columns), audit(good, "SPEAKER_ROLES_CONFIRMED", F.struct("run_id")), refused


def audit(df: DataFrame, event_type: str, detail: Column, encounter: str = "encounter_id", at: str = "created_at") -> DataFrame:
    """Audit rows (encounter_id, event_type, detail, created_at), the detail as JSON."""
    return df.select(F.col(encounter).alias("encounter_id"), F.lit(event_type).alias("event_type"), F.to_json(detail).alias("detail"), F.col(at).alias("created_at"))


def new_encounters(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(encounters, audit rows) to append for (encounter_id, consent_confirmed, created_at): drafts without a version or token."""
    text = F.lit(None).cast("string")
    rows = asked.select(
        "encounter_id", F.lit("DRAFT").alias("status"), F.coalesce("consent_confirmed", F.lit(False)).alias("consent_confirmed"), text.alias("error_code"), text.alias("public_token"),
        text.alias("draft_version_id"), text.alias("approved_version_id"), "created_at", F.col("created_at").alias("updated_at"),
    )
    return rows, audit(rows, "ENCOUNTER_CREATED", F.struct())


def empty_document(schema: str) -> Column:
    """A document of a schema as JSON, with its lists empty and its texts blank."""
    fields = [F.lit("").alias(f.name) if f.dataType.simpleString() == "string" else F.array().cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
    return F.to_json(F.struct(*fields))


def first_versions(encounters: DataFrame, inputs: DataFrame, transitions: Sequence[tuple[str, str]] = K.TRANSITIONS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(versions to append, encounters after the inputs, audit rows to append, rejected inputs).

    ``inputs`` has encounter_id, version_id, transcript_text and created_at; of several for one encounter the earliest counts, then
    the smallest version_id. An encounter takes its first version, with empty documents, if its status may become SUBMITTED; other inputs are rejected.
    """
    allowed = [a for a, b in transitions if b == "SUBMITTED"]
    ready = encounters.where(F.col("status").isin(*allowed)).select("encounter_id")
    good = latest(inputs.join(ready, "encounter_id"), "encounter_id", [F.col("created_at"), F.col("version_id")])
    rejected = inputs.join(good.select("encounter_id", "version_id"), ["encounter_id", "version_id"], "left_anti")
    versions = good.select(
        "version_id", "encounter_id", F.lit(1).alias("version_number"), F.lit("draft").alias("status"), "transcript_text",
        empty_document(STRUCTURE).alias("structure_json"), empty_document(EXPLANATION).alias("explanation_json"), "created_at",
    )
    moved = good.select("encounter_id", F.col("version_id").alias("_v"), F.col("created_at").alias("_at"))
    after = encounters.join(moved, "encounter_id", "left").withColumns({
        "status": F.when(F.col("_v").isNotNull(), "SUBMITTED").otherwise(F.col("status")), "draft_version_id": F.coalesce("_v", "draft_version_id"), "updated_at": F.coalesce("_at", "updated_at"),
    })
    detail = F.struct("version_id", F.length(F.coalesce("transcript_text", F.lit(""))).alias("transcript_len"))
    return versions, after.select(*encounters.columns), audit(versions, "INPUT_SUBMITTED", detail), rejected


def new_runs(asked: DataFrame, segments: DataFrame, order: str, run: str = "run_id") -> DataFrame:
    """Runs to append for ``asked`` (run_id, created_at and others): they wait for the speakers' roles and carry their segments, by ``order``, as a JSON array. One run's segments are a group."""
    rest = [c for c in segments.columns if c not in (run, order)]
    lists = segments.groupBy(run).agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias("_s"))
    out = asked.join(lists, run, "left").withColumn("segments_json", F.coalesce(F.to_json("_s"), F.lit("[]"))).drop("_s")
    return out.withColumns({"status": F.lit("needs_role_confirmation"), "roles_json": F.lit("{}"), "updated_at": F.col("created_at")})


def complete_runs(runs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs after completion, completions without a run) for ``done`` (run_id, completed_at); of several completions the last counts."""
    last = done.groupBy("run_id").agg(F.max("completed_at").alias("_at"))
    after = runs.join(last.withColumn("_done", F.lit(True)), "run_id", "left")
    after = after.withColumns({"status": F.when(F.col("_done"), "completed").otherwise(F.col("status")), "updated_at": F.coalesce("_at", "updated_at")})
    return after.select(*runs.columns), done.join(runs.select("run_id"), "run_id", "left_anti")


def with_grants(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """``asked`` (asset_id, encounter_id) with ``granted``: the asset must be an original of that very encounter. Both sides are read once."""
    keys = ["asset_id", "encounter_id"]
    mine = assets.where("kind = 'original'").select(*keys, F.lit(True).alias("granted")).distinct()
    return asked.join(mine, keys, "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def owned(asked: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(granted, refused) of ``asked`` (asset_id, encounter_id); see with_grants."""
    judged = with_grants(asked, assets)
    return judged.where("granted").select(*asked.columns), judged.where("NOT granted").select(*asked.columns)


def misattributed(spans: DataFrame, segments: DataFrame, by: str, segment: str) -> DataFrame:
    """Per ``by``: spans with a segment, and those of them whose speaker or role is not the segment's."""
    met = spans.alias("a").join(segments.alias("b"), [by, segment])
    same = F.col("a.speaker").eqNullSafe(F.col("b.speaker")) & F.col("a.role").eqNullSafe(F.col("b.role"))
    return met.groupBy(by).agg(F.count("*").alias("n_spans"), F.count_if(~same).alias("n_wrong"))


def promoted_questions(symptoms: DataFrame, by: str) -> DataFrame:
    """Per ``by``: symptoms that only a doctor's question reports and that are no longer marked as a question."""
    wrong = (F.col("reported_by") == "doctor_question") & ~F.col("polarity").eqNullSafe(F.lit("question"))
    return symptoms.groupBy(by).agg(F.count("*").alias("n_symptoms"), F.count_if(wrong).alias("n_promoted"))


def keyword_violations(violations: DataFrame, by: str, text: str, keywords: Sequence[str] = K.UNGROUNDED_KEYWORDS) -> DataFrame:
    """Per ``by``: violations, and those that name one of the keywords."""
    named = reduce(lambda a, b: a | b, [F.col(text).contains(k) for k in keywords])
    return violations.groupBy(by).agg(F.count(text).alias("n_violations"), F.count_if(named).alias("n_ungrounded"))


def grounded(reports: DataFrame) -> DataFrame:
    """One row: fixtures, those that are grounded, and failures."""
    return reports.agg(F.count("*").alias("n_total"), F.count_if("valid").alias("n_grounded"), F.count_if(~F.coalesce(F.col("valid"), F.lit(False))).alias("n_failures"))


def report_lines(df: DataFrame, columns: Sequence[tuple[str, int]]) -> DataFrame:
    """With ``line``: the columns at least as wide as given, the first to the left, numbers to the right with one digit, halves rounded up; a null is a dash."""
    (name, width), *numbers = columns
    first = F.format_string(f"%-{width}s", F.coalesce(F.col(name).cast("string"), F.lit("-")))
    shown = [F.when(F.col(c).isNull(), F.format_string(f"%{w}s", F.lit("-"))).otherwise(F.format_string(f"%{w}.1f", F.round(F.col(c).cast("double"), 1))) for c, w in numbers]
    return df.withColumn("line", F.concat(first, *shown))
