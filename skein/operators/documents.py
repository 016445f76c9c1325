"""Structured documents of a transcript: building, editing, rendering, and changes of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.functions import constants as K
from skein.functions.text import lines, strip
from skein.sources.tables import EXPLANATION, STRUCTURE


def _empty(ddl: str) -> dict[str, Column]:
    """An empty array, or a null, for each field of a document's schema."""
    fields = StructType.fromDDL(ddl).fields
    return {f.name: (F.array() if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType) for f in fields}


def structure_of(text: Column) -> Column:
    """A document in which each line of the text that is not blank is a stated problem."""
    problems = F.transform(lines(text), lambda t, i: F.struct(t.alias("text"), F.lit("stated").alias("certainty"), F.array(F.concat(F.lit("seg-"), i + 1)).alias("source_segment_ids")))
    return F.struct(*[(problems if name == "problems" else empty).alias(name) for name, empty in _empty(STRUCTURE).items()])


def explanation_of(structure: Column, notice: str = K.DRAFT_NOTICE) -> Column:
    """A draft that lists the problems' texts, with the segments they come from."""
    problems = structure["problems"]
    fields = _empty(EXPLANATION) | {
        "draft_notice": F.lit(notice),
        "current_situation": F.transform(problems, lambda p: p["text"]),
        "source_map": F.array(F.struct(F.lit("current_situation").alias("field"), F.flatten(F.transform(problems, lambda p: p["source_segment_ids"])).alias("source_segment_ids"))),
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def edit_problems(structure: Column, edited: Column) -> Column:
    """The document with the edited lines as problems; each takes certainty and sources from the one at its place, new lines are stated and without sources."""
    kept = F.filter(F.transform(F.split(edited, "\n"), strip), lambda t: t != "")

    def one(t, i):
        old = F.get(structure["problems"], i)
        none = F.array().cast("array<string>")
        return F.struct(t.alias("text"), F.coalesce(old["certainty"], F.lit("stated")).alias("certainty"), F.coalesce(old["source_segment_ids"], none).alias("source_segment_ids"))

    return structure.withField("problems", F.transform(kept, one))


def edit_explanation(explanation: Column, notice: Column, fields: dict[str, Column]) -> Column:
    """The draft with a new notice and the given fields' lines."""
    out = explanation.withField("draft_notice", notice)
    for name, text in fields.items():
        out = out.withField(name, F.filter(F.transform(F.split(text, "\n"), strip), lambda t: t != ""))
    return out


def rendered_fields(df: DataFrame, key: str, explanation: str = "explanation", fields: tuple[str, ...] = K.EXPLANATION_FIELDS) -> DataFrame:
    """A row for each field that has items, in order."""
    cells = F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(f).alias("field"), F.col(f"{explanation}.{f}").alias("items")) for n, f in enumerate(fields)])
    return df.select(key, F.explode(cells).alias("_c")).select(key, "_c.*").where(F.size("items") > 0)


def fill(current: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the given columns replaced where ``new`` has a value for the key."""
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = current.join(n, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns])


def migrate(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows in the given schema; columns that are missing are null. Schemas only grow, so a column that it lacks is an error."""
    if extra := set(df.columns) - set(schema.fieldNames()):
        raise ValueError(f"columns that the schema lacks: {sorted(extra)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def with_errors(df: DataFrame, code: str = "error_code") -> DataFrame:
    """Rows with the status and retryability of their error code."""
    table = df.sparkSession.createDataFrame(list(K.ERRORS), f"{code} string, http_status int, retryable boolean")
    return df.join(F.broadcast(table), code, "left")  # a table of fixed size


def audit_of_asset(assets: DataFrame) -> DataFrame:
    """The audit event of each asset row."""
    kind = F.when(F.col("kind") == "original", "AUDIO_UPLOADED").otherwise("AUDIO_PREPROCESSED")
    return assets.select("encounter_id", kind.alias("event_type"), F.create_map(F.lit("asset_id"), F.col("asset_id").cast("string")).alias("metadata"), "created_at")


def enrollment_windows(clips: DataFrame, key: str, duration_ms: str = "duration_ms") -> DataFrame:
    """Windows of ten seconds over each clip; those under two seconds are left out."""
    out = clips.withColumn("start_ms", F.explode(F.expr(f"sequence(0L, greatest(0L, {duration_ms} - 1), {K.ENROLL_WINDOW_MS}L)")))
    out = out.withColumn("end_ms", F.least(F.col("start_ms") + K.ENROLL_WINDOW_MS, F.col(duration_ms)))
    return out.where(F.col("end_ms") - F.col("start_ms") >= K.MIN_WINDOW_MS).select(key, "start_ms", "end_ms")


def cluster_seconds(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Speech of each cluster, and how many of its turns are long enough for an embedding."""
    ms = F.col("end_ms") - F.col("start_ms")
    return turns.groupBy(key, "speaker_index").agg((F.sum(ms) / 1000).alias("seconds"), F.count_if(ms >= K.MIN_EMBED_MS).alias("n_chunks"))
