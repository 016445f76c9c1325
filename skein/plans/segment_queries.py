"""Queries on segments and their alignment, over conversations as timed segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.shared import table
from skein.operators import align, segments
from skein.sources.tables import SEG_SQL, hypothesis_segments, text_segments, timed_segments


def merge_turns(spark, sf_dir):
    return segments.merge_turns(timed_segments(spark, sf_dir))


_ISLAND = """{name} AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY start_ms, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS island FROM (
    SELECT *, CASE WHEN lag(speaker_index) OVER w = speaker_index AND start_ms - lag(end_ms) OVER w < {gap} THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY conv_id ORDER BY start_ms, turn))
)"""
_MERGED = f"""WITH {SEG_SQL}, {_ISLAND.format(name='isl', gap=800)}, merged AS (
  SELECT conv_id, island::BIGINT AS turn, any_value(speaker_index)::BIGINT AS speaker_index, min(start_ms)::BIGINT AS start_ms, arg_max(end_ms, turn)::BIGINT AS end_ms, count(*)::BIGINT AS n_turns FROM isl GROUP BY conv_id, island)
"""
MERGE_TURNS = _MERGED + "SELECT * FROM merged"


def split_long_turns(spark, sf_dir):
    return segments.split_turns(segments.merge_turns(timed_segments(spark, sf_dir)))


SPLIT_LONG_TURNS = _MERGED + """, n AS (SELECT *, greatest(1, ceil((end_ms - start_ms) / 28000.0))::BIGINT AS n FROM merged)
SELECT conv_id, turn, piece, speaker_index, (start_ms + ((end_ms - start_ms) * piece) // n)::BIGINT AS start_ms, least(start_ms + ((end_ms - start_ms) * (piece + 1)) // n, end_ms)::BIGINT AS end_ms
FROM (SELECT *, unnest(range(0, n)) AS piece FROM n)"""


def merge_utterances(spark, sf_dir):
    rows = segments.merge_utterances(timed_segments(spark, sf_dir))
    out = segments.label_segments(rows)
    return out.select("conv_id", "segment_id", "speaker", "start_ms", "end_ms", "text")


MERGE_UTTERANCES = f"""WITH {SEG_SQL}, {_ISLAND.format(name='isl', gap=8000)}
SELECT conv_id, format('seg_{{:03d}}', (island + 1)::INT) AS segment_id, chr((65 + any_value(speaker_index))::INT) AS speaker, min(start_ms)::BIGINT AS start_ms, arg_max(end_ms, turn)::BIGINT AS end_ms,
  string_agg(trim(ltrim(trim(text), '-')), ' ' ORDER BY turn) AS text
FROM isl GROUP BY conv_id, island"""


def garbage_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", T.is_garbage(F.col("text"), F.lit(1000)).alias("garbage"))


GARBAGE_FILTER = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s*-*\s*', ''), '\s+$', '') AS t FROM documents)
SELECT doc_id, length(t) <= 1 OR NOT regexp_matches(t, '[\p{L}\p{M}\p{N}]') OR regexp_matches(t, '[\x{0370}-\x{03FF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]')
  OR contains(t, '이곳은 한국') OR contains(t, '공공기관') OR contains(t, '구독') OR contains(t, '시청해주셔') OR contains(t, 'MBC') OR contains(t, 'KBS 뉴스') AS garbage FROM c"""


def transcript_build(spark, sf_dir):
    segs = timed_segments(spark, sf_dir).withColumn("speaker", segments.speaker_letter(F.col("speaker_index")))
    roles = F.create_map(F.lit("A"), F.lit("doctor"), F.lit("B"), F.lit("patient"))
    return segments.build_transcript(segs, roles)


TRANSCRIPT_BUILD = f"""WITH {SEG_SQL}
SELECT conv_id, string_agg(CASE speaker_index WHEN 0 THEN '의사' WHEN 1 THEN '환자' ELSE '화자' END || ': ' || text, chr(10) ORDER BY start_ms, turn) AS transcript FROM seg GROUP BY conv_id"""


def transcript_segments(spark, sf_dir):
    return text_segments(table(spark, sf_dir, "documents"), "doc_id")


TRANSCRIPT_SEGMENTS = r"""SELECT doc_id, 'seg-' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS segment_id, text FROM (
  SELECT doc_id, i, trim(line) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE text <> ''"""


def best_overlap_align(spark, sf_dir):
    """Each hypothesis segment's turn."""
    return best_overlap_align_all(spark, sf_dir)


def best_overlap_align_all(spark, sf_dir):
    """All hypothesis segments against all turns."""
    turns = timed_segments(spark, sf_dir)
    return align.best_overlap(hypothesis_segments(turns).withColumnRenamed("turn", "seg"), turns)


BEST_OVERLAP_ALIGN_ALL = f"""WITH {SEG_SQL}, p AS (
  SELECT h.conv_id, h.turn AS seg, s.turn, s.speaker_index, greatest(0, least(h.end_ms, s.end_ms) - greatest(h.start_ms, s.start_ms)) AS o, abs(h.start_ms - s.start_ms) AS d
  FROM hyp h JOIN seg s ON h.conv_id = s.conv_id
)
SELECT conv_id, seg, turn, speaker_index, o::BIGINT AS overlap_ms FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, turn) AS k FROM p) WHERE k = 1"""

BEST_OVERLAP_ALIGN = BEST_OVERLAP_ALIGN_ALL


def gt_text_match(spark, sf_dir):
    truth = timed_segments(spark, sf_dir)
    return align.text_by_overlap(truth, hypothesis_segments(truth))


_DOMINANT = f"""WITH {SEG_SQL}, o AS (
  SELECT g.conv_id, g.turn, g.speaker_index AS gt, p.turn AS pturn, p.start_ms AS ps, p.text AS ptext, p.speaker_index AS pred, least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) AS ms
  FROM seg g JOIN hyp p ON g.conv_id = p.conv_id AND least(g.end_ms, p.end_ms) - greatest(g.start_ms, p.start_ms) > 0
), m AS (
  SELECT conv_id, turn, string_agg(ptext, ' ' ORDER BY ps, pturn) AS matched_text, count(*)::BIGINT AS n_overlaps FROM o GROUP BY conv_id, turn
), d AS (
  SELECT conv_id, turn, gt, pred FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY ms DESC, ps, pturn) AS k FROM o) WHERE k = 1
)"""
GT_TEXT_MATCH = _DOMINANT + """
SELECT seg.conv_id, seg.turn, coalesce(matched_text, '') AS matched_text, pred AS speaker_index, coalesce(n_overlaps, 0)::BIGINT AS n_overlaps FROM seg LEFT JOIN m USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn)"""


def speaker_mapping_accuracy(spark, sf_dir):
    truth = timed_segments(spark, sf_dir)
    return align.speaker_mapping_accuracy(truth, hypothesis_segments(truth))


SPEAKER_MAPPING_ACCURACY = _DOMINANT + """, s AS (SELECT conv_id, pred, gt, sum(ms) AS ms FROM o GROUP BY conv_id, pred, gt
), l AS (SELECT conv_id, pred, gt AS mapped FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pred ORDER BY ms DESC, gt) AS k FROM s) WHERE k = 1
)
SELECT conv_id, count(*)::BIGINT AS total, count(*) FILTER (mapped = gt)::BIGINT AS correct, count(*) FILTER (mapped = gt)::DOUBLE / count(*) AS accuracy FROM d JOIN l USING (conv_id, pred) GROUP BY conv_id"""


def first_seen_speaker(spark, sf_dir):
    segs = timed_segments(spark, sf_dir)
    first = F.min(F.struct("turn", "text"))["text"].alias("example_text")
    return segs.groupBy("conv_id", segments.speaker_letter(F.col("speaker_index")).alias("speaker")).agg(first, F.count("*").alias("n_segments"))


FIRST_SEEN_SPEAKER = f"""WITH {SEG_SQL}
SELECT conv_id, chr((65 + speaker_index)::INT) AS speaker, arg_min(text, turn) AS example_text, count(*)::BIGINT AS n_segments FROM seg GROUP BY conv_id, speaker_index"""


def running_cursor(spark, sf_dir):
    return timed_segments(spark, sf_dir).select("conv_id", "turn", "start_ms", "end_ms", "speaker_index")


RUNNING_CURSOR = f"WITH {SEG_SQL} SELECT conv_id, turn, start_ms, end_ms, speaker_index FROM seg"


def role_subset_check(spark, sf_dir):
    """Whether a role map, made from the conversation's number, names only speakers of the conversation."""
    segs = timed_segments(spark, sf_dir).withColumn("speaker", segments.speaker_letter(F.col("speaker_index")))
    df = segs.groupBy("conv_id").agg(F.sort_array(F.collect_set("speaker")).alias("known"))
    named = F.when(F.col("conv_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.filter(F.array(F.lit("A"), F.lit("B"), F.lit("C")), lambda x, i: i <= F.col("conv_id") % 3))
    missing = F.array_except(named, "known")
    return df.select("conv_id", F.array_join("known", ",").alias("known"), F.array_join(missing, ",").alias("missing"), ((F.size(named) > 0) & (F.size(missing) == 0)).alias("valid"))


ROLE_SUBSET_CHECK = f"""WITH {SEG_SQL}, k AS (SELECT conv_id, list_sort(list(DISTINCT chr((65 + speaker_index)::INT))) AS known FROM seg GROUP BY conv_id
), n AS (SELECT *, CASE WHEN conv_id % 7 = 0 THEN [] ELSE (['A', 'B', 'C'])[1:(conv_id % 3 + 1)::INT] END AS named FROM k
), x AS (SELECT *, list_filter(named, lambda v: NOT list_contains(known, v)) AS missing FROM n)
SELECT conv_id, array_to_string(known, ',') AS known, array_to_string(missing, ',') AS missing, len(named) > 0 AND len(missing) = 0 AS valid FROM x"""

QUERIES = {
    "merge_turns": (merge_turns, MERGE_TURNS),
    "split_long_turns": (split_long_turns, SPLIT_LONG_TURNS),
    "merge_utterances": (merge_utterances, MERGE_UTTERANCES),
    "garbage_filter": (garbage_filter, GARBAGE_FILTER),
    "transcript_build": (transcript_build, TRANSCRIPT_BUILD),
    "transcript_segments": (transcript_segments, TRANSCRIPT_SEGMENTS),
    "best_overlap_align": (best_overlap_align, BEST_OVERLAP_ALIGN),
    "best_overlap_align_all": (best_overlap_align_all, BEST_OVERLAP_ALIGN_ALL),
    "gt_text_match": (gt_text_match, GT_TEXT_MATCH),
    "speaker_mapping_accuracy": (speaker_mapping_accuracy, SPEAKER_MAPPING_ACCURACY),
    "first_seen_speaker": (first_seen_speaker, FIRST_SEEN_SPEAKER),
    "running_cursor": (running_cursor, RUNNING_CURSOR),
    "role_subset_check": (role_subset_check, ROLE_SUBSET_CHECK),
}
