"""Queries of evaluation metrics: edit rates, diarization error, enrolment."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.shared import table
from skein.operators import diarization, edit, enrollment
from skein.sources.tables import SEG_SQL, hypothesis_segments, timed_segments


def edit_rate_micro(spark, sf_dir):
    """Character error rate of a damaged copy of each conversation turn, micro-averaged by role."""
    a = F.regexp_replace("text", "[^ -~]", "?")
    df = table(spark, sf_dir, "conversations").select("role", a.alias("ref"), F.regexp_replace(F.regexp_replace(a, "th", "t"), "e", "ee").alias("hyp"))
    errors, length = edit.character_errors(F.col("ref"), F.col("hyp"))
    out = edit.micro_average(df.select("role", errors.alias("errors"), length.alias("length")), ["role"])
    return out.withColumn("rate", F.round("rate", 9))


EDIT_RATE_MICRO = """WITH a AS (SELECT role, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM conversations),
b AS (SELECT role, replace(t, ' ', '') AS ref, replace(replace(replace(t, 'th', 't'), 'e', 'ee'), ' ', '') AS hyp FROM a),
e AS (SELECT role, levenshtein(ref, hyp) AS errors, length(ref) AS length FROM b)
SELECT role, sum(errors)::BIGINT AS errors, sum(length)::BIGINT AS length, round(sum(errors)::DOUBLE / sum(length), 9) AS rate FROM e GROUP BY role"""


def edit_ops_sdi(spark, sf_dir):
    """Word substitutions, deletions and insertions of a damaged copy of each turn."""
    hyp = F.array_join(F.filter(F.transform(F.split("text", " "), lambda w, i: F.when(i % 7 == 3, F.lit("um")).when(i % 11 == 5, F.lit("")).otherwise(w)), lambda w: w != ""), " ")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", hyp.alias("hyp"))
    return edit.with_operations(df, "text", "hyp").select("conv_id", "turn", "substitutions", "deletions", "insertions", "length", F.round("rate", 9).alias("rate"))


#: Prefixes of both texts by rising sum of their lengths: the errors and deletions of one sum follow from the two sums before.
EDIT_OPS_SDI = r"""WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id, turn, string_split(text, ' ') AS w FROM conversations
), p AS (SELECT id, conv_id, turn, list_filter(regexp_split_to_array(array_to_string(w, ' '), '\s+'), lambda x: x <> '') AS a,
    list_filter(regexp_split_to_array(array_to_string([CASE WHEN i % 7 = 3 THEN 'um' WHEN i % 11 = 5 THEN '' ELSE w[i + 1] END for i in range(len(w))], ' '), '\s+'), lambda x: x <> '') AS b FROM c
), s AS (SELECT id, len(a) AS n, len(b) AS m FROM p), x AS (SELECT id, unnest(a) AS u, unnest(range(1, len(a) + 1)) AS i FROM p), y AS (SELECT id, unnest(b) AS v, unnest(range(1, len(b) + 1)) AS j FROM p
), r AS (
  SELECT s.id, n, m, i, u, 0::BIGINT AS t, CASE WHEN i = 0 THEN 0::BIGINT END AS e1, 0::BIGINT AS d1, NULL::BIGINT AS e2, 0::BIGINT AS d2 FROM s JOIN (SELECT id, i, u FROM x UNION ALL SELECT id, 0, '' FROM s) q ON q.id = s.id
  UNION ALL
  SELECT id, n, m, i, u, t, CASE WHEN j < 0 OR j > m THEN NULL WHEN i = 0 THEN j WHEN j = 0 THEN i ELSE least(sub, del, ins) END,
    CASE WHEN i = 0 THEN 0 WHEN j = 0 THEN i WHEN sub = least(sub, del, ins) THEN sd WHEN del = least(sub, del, ins) THEN dd + 1 ELSE id1 END, o1, od1
  FROM (
    SELECT r.id, r.n, r.m, r.i, r.u, r.t + 1 AS t, r.t + 1 - r.i AS j, r.e1 + 1 AS ins, r.d1 AS id1, q.e1 + 1 AS del, q.d1 AS dd, q.e2 + (r.u <> coalesce(y.v, ''))::BIGINT AS sub, q.d2 AS sd, r.e1 AS o1, r.d1 AS od1
    FROM r LEFT JOIN r q ON q.id = r.id AND q.i = r.i - 1 LEFT JOIN y ON y.id = r.id AND y.j = r.t + 1 - r.i WHERE r.t < r.n + r.m)
), f AS (SELECT id, e1 AS e, d1 AS d, n, m FROM r WHERE t = n + m AND i = n)
SELECT conv_id, turn, e - 2 * d - (m - n) AS substitutions, d AS deletions, d + m - n AS insertions, n::BIGINT AS length, round(CASE WHEN n > 0 THEN e::DOUBLE / n WHEN e > 0 THEN 'inf'::DOUBLE ELSE 0 END, 9) AS rate FROM f JOIN p USING (id)"""


def _sides(spark, sf_dir):
    segs = timed_segments(spark, sf_dir)
    role = F.when(F.col("speaker_index") == 0, "doctor").when(F.col("speaker_index") == 1, "patient").otherwise("contamination")
    ref = segs.select("conv_id", F.col("speaker_index").alias("speaker"), role.alias("role"), "start_ms", "end_ms")
    # every fifth turn is heard half a second into the next one, so that speech overlaps
    late = F.when(F.col("turn") % 5 == 1, 500).otherwise(0)
    hyp = hypothesis_segments(segs).select("conv_id", F.col("speaker_index").alias("speaker"), "start_ms", (F.col("end_ms") + late).alias("end_ms"))
    return ref, hyp


def der_components(spark, sf_dir):
    ref, hyp = _sides(spark, sf_dir)
    df = diarization.error_rate(ref, hyp)
    return df.select("conv_id", *[F.round(c, 9).alias(c) for c in ("der", "missed", "false_alarm", "confusion", "scored", "overlap_recall", "role_purity")], "ref_speakers", "hyp_speakers")


_CELLS = f"""{SEG_SQL}, r AS (SELECT conv_id, speaker_index AS s, start_ms AS a, end_ms AS b FROM seg WHERE end_ms > start_ms
), h AS (SELECT conv_id, speaker_index AS s, start_ms AS a, end_ms + CASE WHEN turn % 5 = 1 THEN 500 ELSE 0 END AS b FROM hyp WHERE end_ms + CASE WHEN turn % 5 = 1 THEN 500 ELSE 0 END > start_ms
), c AS (SELECT conv_id, unnest([a, b]) AS b FROM r
), cap AS (SELECT conv_id, (round_even(max(b) / 10.0, 0) * 10)::BIGINT AS cap FROM (SELECT conv_id, b FROM r UNION ALL SELECT conv_id, b FROM h) GROUP BY conv_id
), pt AS (
  SELECT DISTINCT conv_id, p FROM (SELECT conv_id, unnest([a, b]) AS p FROM r UNION ALL SELECT conv_id, unnest([a, b]) FROM h UNION ALL SELECT conv_id, unnest([b - {{collar}} + 1, b + {{collar}}]) FROM c UNION ALL SELECT conv_id, 0 FROM cap) WHERE p >= 0
), iv AS (
  SELECT conv_id, p, ceil((least(q, cap) - 5) / 10.0) - ceil((least(p, cap) - 5) / 10.0) AS f FROM (SELECT *, lead(p) OVER (PARTITION BY conv_id ORDER BY p) AS q FROM pt) JOIN cap USING (conv_id) WHERE q IS NOT NULL
), sc AS (
  SELECT * FROM iv WHERE f > 0 AND ({{collar}} = 0 OR NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = iv.conv_id AND c.b - {{collar}} + 1 <= iv.p AND c.b + {{collar}} > iv.p))
), k AS (
  SELECT conv_id, p, f, coalesce((SELECT list_sort(list(DISTINCT r.s)) FROM r WHERE r.conv_id = sc.conv_id AND r.a <= sc.p AND r.b > sc.p), []) AS rs,
    coalesce((SELECT list_sort(list(DISTINCT h.s)) FROM h WHERE h.conv_id = sc.conv_id AND h.a <= sc.p AND h.b > sc.p), []) AS hs FROM sc
)"""
_C250 = "WITH " + _CELLS.replace("{collar}", "250")
DER_COMPONENTS = _C250 + """, m AS (
  SELECT conv_id, x.r, y.h, sum(CASE WHEN list_contains(rs, x.r) AND list_contains(hs, y.h) THEN f ELSE 0 END) AS f FROM k, (VALUES (0), (1), (2)) AS x(r), (VALUES (0), (1), (2)) AS y(h) GROUP BY conv_id, x.r, y.h
), best AS (
  SELECT a.conv_id, max(a.f + b.f + c.f) AS correct FROM m a, m b, m c WHERE a.conv_id = b.conv_id AND b.conv_id = c.conv_id AND a.r = 0 AND b.r = 1 AND c.r = 2 AND a.h <> b.h AND b.h <> c.h AND a.h <> c.h GROUP BY a.conv_id
), s AS (
  SELECT conv_id, sum(greatest(0, len(rs) - len(hs)) * f) AS missed, sum(greatest(0, len(hs) - len(rs)) * f) AS fa, sum(least(len(rs), len(hs)) * f) AS bo, sum(len(rs) * f) AS scored,
    sum(CASE WHEN len(rs) >= 2 THEN f END) AS ov, sum(CASE WHEN len(rs) >= 2 AND len(hs) >= 2 THEN f ELSE 0 END) AS fo FROM k GROUP BY conv_id
), u AS (
  SELECT conv_id, sum(most)::DOUBLE / sum(al) AS role_purity FROM (SELECT conv_id, h, max(f) AS most, sum(f) AS al FROM (SELECT conv_id, rs[1] AS r, unnest(hs) AS h, f FROM k WHERE len(rs) = 1) AS z(conv_id, r, h, f0)
    JOIN (SELECT 1) ON TRUE, LATERAL (SELECT f0 AS f) GROUP BY conv_id, h, r) GROUP BY conv_id
), n AS (SELECT conv_id, count(DISTINCT s)::BIGINT AS ref_speakers FROM r GROUP BY conv_id), nh AS (SELECT conv_id, count(DISTINCT s)::BIGINT AS hyp_speakers FROM h GROUP BY conv_id)
SELECT n.conv_id, round((missed + fa + bo - correct)::DOUBLE / scored, 9) AS der, round_even(missed * 0.01, 3)::DOUBLE AS missed, round_even(fa * 0.01, 3)::DOUBLE AS false_alarm, round_even((bo - correct) * 0.01, 3)::DOUBLE AS confusion,
  round_even(scored * 0.01, 3)::DOUBLE AS scored, round(fo::DOUBLE / ov, 9) AS overlap_recall, round(role_purity, 9) AS role_purity, ref_speakers, coalesce(hyp_speakers, 0) AS hyp_speakers
FROM n LEFT JOIN nh USING (conv_id) LEFT JOIN s USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN u USING (conv_id)"""
DER_COMPONENTS = DER_COMPONENTS.replace("""(SELECT conv_id, h, max(f) AS most, sum(f) AS al FROM (SELECT conv_id, rs[1] AS r, unnest(hs) AS h, f FROM k WHERE len(rs) = 1) AS z(conv_id, r, h, f0)
    JOIN (SELECT 1) ON TRUE, LATERAL (SELECT f0 AS f) GROUP BY conv_id, h, r)""", """(SELECT conv_id, h, max(f) AS most, sum(f) AS al FROM (SELECT conv_id, r, h, sum(f) AS f FROM (SELECT conv_id, rs[1] AS r, unnest(hs) AS h, f FROM k WHERE len(rs) = 1) GROUP BY conv_id, r, h) GROUP BY conv_id, h)""")


def voiceprint_centroid(spark, sf_dir):
    df = enrollment.voiceprints(table(spark, sf_dir, "embeddings"), "label")
    return df.select("label", "n", F.posexplode("voiceprint").alias("pos", "x")).select("label", "n", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


_UNIT = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e
), c AS (SELECT label, pos, avg(x) AS x, count(*)::BIGINT AS n FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM u) GROUP BY label, pos
), cv AS (SELECT label, list(x ORDER BY pos) AS m, max(n) AS n FROM c GROUP BY label), vp AS (SELECT label, n, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM cv)"""
VOICEPRINT_CENTROID = f"WITH {_UNIT} SELECT label, n, unnest(range(64)) AS pos, round(unnest(v), 6) AS x FROM vp"


def _clusters(spark, sf_dir):
    prints = enrollment.voiceprints(table(spark, sf_dir, "embeddings"), "label")
    clusters = prints.select(F.col("label").alias("cluster"), F.col("voiceprint").alias("embedding"), (F.col("n") * (F.col("label") + 1)).alias("seconds"))
    return prints, enrollment.label_clusters(clusters, prints.where("label = 3"))


def cluster_label(spark, sf_dir):
    _, out = _clusters(spark, sf_dir)
    return out.select("cluster", F.round("similarity", 6).alias("similarity"), F.round("share", 6).alias("share"), F.col("label"))


_CL = f"""WITH {_UNIT}, d AS (SELECT label AS cluster, list_dot_product(v, (SELECT v FROM vp WHERE label = 3)) AS similarity, n * (label + 1) / (SELECT sum(n * (label + 1)) FROM vp)::DOUBLE AS share FROM vp
), dl AS (SELECT *, CASE WHEN similarity >= 0.5 THEN 'doctor' WHEN share < 0.1 THEN 'contamination' ELSE 'other' END AS label FROM d)"""
CLUSTER_LABEL = _CL + " SELECT cluster, round(similarity, 6) AS similarity, round(share, 6) AS share, label FROM dl"


def turn_label(spark, sf_dir):
    prints, decisions = _clusters(spark, sf_dir)
    doctor = prints.where("label = 3").select(F.col("voiceprint").alias("_v")).limit(1)
    turns = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(doctor))  # one row
    sim = F.when(F.col("vec_id") % 6 != 0, enrollment.cosine(F.col("embedding"), F.col("_v")))
    return enrollment.label_turns(turns.select("vec_id", F.col("label").alias("cluster"), sim.alias("similarity")), decisions).select("vec_id", "cluster", "label")


TURN_LABEL = _CL + """, t AS (SELECT vec_id, label AS cluster, CASE WHEN vec_id % 6 <> 0 THEN list_dot_product(v, (SELECT v FROM vp WHERE label = 3)) END AS sim FROM u)
SELECT vec_id, cluster, CASE WHEN sim IS NULL THEN label WHEN sim >= 0.5 THEN 'doctor' WHEN label = 'contamination' THEN 'contamination' ELSE 'other' END AS label FROM t JOIN dl USING (cluster)"""


def impostor_max(spark, sf_dir):
    """For each cluster that is mostly the doctor's, the greatest similarity to another doctor's voiceprint. Labels stand for doctors, each with seven clusters."""
    e = table(spark, sf_dir, "embeddings").withColumn("cluster", F.col("label") * 7 + F.col("vec_id") % 7)
    own = e.groupBy("cluster").agg(F.any_value("label").alias("doctor"), (F.count_if(F.expr("vec_id div 7 % 2 = 0")) * 2 > F.count("*")).alias("_true")).where("_true").drop("_true")
    clusters = enrollment.voiceprints(e, "cluster").select("cluster", F.col("voiceprint").alias("embedding")).join(own, "cluster")
    prints = enrollment.voiceprints(e, "label").select(F.col("label").alias("doctor"), "voiceprint")
    return enrollment.impostors(clusters, prints, "cluster").select("cluster", "doctor", F.round("impostor", 6).alias("impostor_max"))


IMPOSTOR_MAX = f"""WITH {_UNIT}, k AS (SELECT vec_id, label * 7 + vec_id % 7 AS cluster, label, v FROM u
), o AS (SELECT cluster, any_value(label) AS doctor FROM k GROUP BY cluster HAVING count(*) FILTER (vec_id // 7 % 2 = 0) * 2 > count(*)
), kp AS (SELECT cluster, list(x ORDER BY pos) AS m FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS pos FROM k) GROUP BY cluster, pos) GROUP BY cluster
), kv AS (SELECT cluster, doctor, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS v FROM kp JOIN o USING (cluster))
SELECT cluster, doctor, round(max(list_dot_product(kv.v, vp.v)), 6) AS impostor_max FROM kv JOIN vp ON vp.label <> kv.doctor GROUP BY cluster, doctor"""


def enrollment_score(spark, sf_dir):
    ref, hyp = _sides(spark, sf_dir)
    label = F.when(F.col("speaker") == 0, "doctor").when(F.col("speaker") == 1, "other").otherwise("contamination")
    decisions = hyp.select("conv_id", "speaker").distinct().withColumn("label", label)
    out = enrollment.score(ref, hyp, decisions)
    return out.select("conv_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


ENROLLMENT_SCORE = _C250 + """
SELECT conv_id, round(sum(CASE WHEN list_contains(hs, 0) AND list_contains(rs, 0) THEN f ELSE 0 END)::DOUBLE / sum(CASE WHEN list_contains(rs, 0) THEN f END), 9) AS doctor_recall,
  round(sum(CASE WHEN list_contains(hs, 0) AND list_contains(rs, 0) THEN f ELSE 0 END)::DOUBLE / sum(CASE WHEN list_contains(hs, 0) THEN f END), 9) AS doctor_precision,
  round(sum(CASE WHEN rs = [2] AND (list_contains(hs, 0) OR list_contains(hs, 1)) THEN f WHEN rs = [2] THEN 0 END)::DOUBLE / sum(CASE WHEN rs = [2] THEN f END), 9) AS contamination_kept,
  round(sum(CASE WHEN (list_contains(rs, 0) OR list_contains(rs, 1)) AND hs = [2] THEN f ELSE 0 END)::DOUBLE / sum(CASE WHEN list_contains(rs, 0) OR list_contains(rs, 1) THEN f END), 9) AS conversation_dropped
FROM k WHERE len(rs) + len(hs) > 0 GROUP BY conv_id"""


def similarity_margin(spark, sf_dir):
    ref, hyp = _sides(spark, sf_dir)
    decisions = hyp.select("conv_id", "speaker").distinct().withColumn("similarity", 1 / (1 + F.col("speaker") + F.col("conv_id") % 4))
    return enrollment.similarity_margin(decisions, enrollment.majority_roles(ref, hyp)).select("conv_id", F.round("margin", 9).alias("margin"))


SIMILARITY_MARGIN = "WITH " + _CELLS.replace("{collar}", "0") + """, t AS (SELECT conv_id, h, r, sum(f) AS f FROM (SELECT conv_id, h, unnest(rs) AS r, f FROM (SELECT conv_id, rs, unnest(hs) AS h, f FROM k)) GROUP BY conv_id, h, r
), m AS (SELECT conv_id, h, r FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, h ORDER BY f DESC, CASE r WHEN 0 THEN 'doctor' WHEN 1 THEN 'patient' ELSE 'contamination' END) AS k FROM t) WHERE k = 1
)
SELECT conv_id, round(min(CASE WHEN r = 0 THEN 1.0::DOUBLE / (1 + h + conv_id % 4) END) - max(CASE WHEN r <> 0 THEN 1.0::DOUBLE / (1 + h + conv_id % 4) END), 9) AS margin FROM m GROUP BY conv_id"""

QUERIES = {
    "edit_rate_micro": (edit_rate_micro, EDIT_RATE_MICRO),
    "edit_ops_sdi": (edit_ops_sdi, EDIT_OPS_SDI),
    "der_components": (der_components, DER_COMPONENTS),
    "voiceprint_centroid": (voiceprint_centroid, VOICEPRINT_CENTROID),
    "cluster_label": (cluster_label, CLUSTER_LABEL),
    "turn_label": (turn_label, TURN_LABEL),
    "impostor_max": (impostor_max, IMPOSTOR_MAX),
    "enrollment_score": (enrollment_score, ENROLLMENT_SCORE),
    "similarity_margin": (similarity_margin, SIMILARITY_MARGIN),
}
