"""Sources: tables, JSON sidecars, and segments derived from conversations and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.shared import table
from skein.functions.text import lines

SEGMENT = "struct<id:string,speaker:string,role:string,expected_role:string,start:double,end:double,text:string,vital_sign_pattern:string>"
STRUCTURE = (
    "problems array<struct<text:string,certainty:string,source_segment_ids:array<string>>>, "
    "tests array<struct<name:string,reason:string,status:string,source_segment_ids:array<string>>>, "
    "medications array<struct<name:string,dose:string,route:string,frequency:string,action:string,source_segment_ids:array<string>,needs_confirmation:boolean>>, "
    "plan array<struct<text:string,source_segment_ids:array<string>>>, warnings array<struct<text:string,source_segment_ids:array<string>>>, "
    "follow_up array<struct<text:string,source_segment_ids:array<string>>>, questions_or_conflicts array<string>"
)
EXPLANATION = (
    "draft_notice string, current_situation array<string>, tests_and_reasons array<string>, treatment_plan array<string>, medication_instructions array<string>, "
    "warning_signs array<string>, what_to_do_next array<string>, follow_up array<string>, items_to_confirm_with_clinician array<string>, "
    "source_map array<struct<field:string,source_segment_ids:array<string>>>"
)


def parse_segments(raw: DataFrame, text: str) -> DataFrame:
    """Segments of JSON sidecars in the column ``text``, {"segments": [...]} or a bare list, in order (ord); the role is unknown until a person confirms it. Other text has no segments."""
    others = [c for c in raw.columns if c != text]
    rows = raw.select(*others, F.trim(text).alias("_json"))
    wrapped = F.from_json("_json", f"struct<segments:array<{SEGMENT}>>")["segments"]
    bare = F.from_json("_json", f"array<{SEGMENT}>")
    rows = rows.select(*others, F.posexplode(F.when(F.col("_json").startswith("["), bare).otherwise(wrapped)).alias("ord", "s"))
    return rows.select(*others, "ord", "s.*").withColumn("role", F.lit("unknown"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of JSON sidecars, a file each; see parse_segments."""
    return parse_segments(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"), "value")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed documents of JSON files; see STRUCTURE and EXPLANATION."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with the JSON in ``column`` as a typed document; null where it is no JSON object."""
    return df.withColumn(column, F.from_json(column, schema))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files of several schemas in one folder, by the union of their columns, whatever their order; what a file lacks is null. A column of two types is an error."""
    return spark.read.option("mergeSchema", True).parquet(path)


def text_segments(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A segment for each line that is not blank, numbered from 1."""
    out = df.select(key, F.posexplode(lines(F.col(text))).alias("_i", "text"))
    return out.select(key, F.concat(F.lit("seg-"), F.col("_i") + 1).alias("segment_id"), "text")


def timed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with speakers and times in milliseconds: each lasts 60 ms a character and follows a pause."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    dur = (F.length("text") * 60).cast("long")
    gap = (300 + ((F.col("conv_id") * 3 + F.col("turn") * 7) % 10) * 100).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    df = c.withColumn("_d", dur).withColumn("start_ms", F.coalesce(F.sum(dur + gap).over(before), F.lit(0)).cast("long"))
    df = df.withColumn("end_ms", F.col("start_ms") + F.col("_d")).drop("_d")
    return df.withColumn("speaker_index", ((F.col("conv_id") * 5 + F.expr("turn div 2")) % 3).cast("long"))


def hypothesis_segments(segments: DataFrame) -> DataFrame:
    """A second timeline of the same turns: shifted by up to 0.2 s, with every eleventh turn given to another speaker."""
    shift = (F.col("conv_id") * 7 + F.col("turn") * 13) % 400 - 200
    wrong = (F.col("conv_id") + F.col("turn")) % 11 == 0
    return segments.select(
        "conv_id", "turn", "text",
        F.greatest(F.lit(0), F.col("start_ms") + shift).cast("long").alias("start_ms"),
        F.greatest(F.lit(0), F.col("end_ms") + shift).cast("long").alias("end_ms"),
        F.when(wrong, (F.col("speaker_index") + 1) % 3).otherwise(F.col("speaker_index")).cast("long").alias("speaker_index"),
    )


#: DuckDB twins of timed_segments and hypothesis_segments: common table expressions seg and hyp.
SEG_SQL = """seg AS (
  SELECT conv_id, turn, role, text, start_ms, start_ms + dur AS end_ms, ((conv_id * 5 + turn // 2) % 3)::BIGINT AS speaker_index FROM (
    SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms
    FROM (SELECT *, length(text) * 60 AS dur, 300 + ((conv_id * 3 + turn * 7) % 10) * 100 AS gap FROM conversations))
), hyp AS (
  SELECT conv_id, turn, text, greatest(0, start_ms + (conv_id * 7 + turn * 13) % 400 - 200)::BIGINT AS start_ms, greatest(0, end_ms + (conv_id * 7 + turn * 13) % 400 - 200)::BIGINT AS end_ms,
    (CASE WHEN (conv_id + turn) % 11 = 0 THEN (speaker_index + 1) % 3 ELSE speaker_index END)::BIGINT AS speaker_index FROM seg
)"""
