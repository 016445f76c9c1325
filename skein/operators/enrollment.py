"""Speaker enrolment: voiceprints, labels of clusters and turns, and their scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.shared import broadcast_if_small, checkpointed
from skein.operators.diarization import elementary_intervals


def dot(a: Column, b: Column) -> Column:
    """Sum of the products of two vectors; null if either is, an error if their lengths differ."""
    same = F.when(F.size(a) == F.size(b), a).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("vectors of different lengths")).cast("array<double>"))
    return F.aggregate(F.zip_with(same, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    """A vector of unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(normalize(a), normalize(b))


def voiceprints(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """(by, voiceprint, n): mean of the unit vectors, of unit length again. Means are taken by position, so no group is collected."""
    unit = df.select(by, F.posexplode(normalize(F.col(vector))).alias("pos", "x"))
    mean = unit.groupBy(by, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    print_ = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"])
    return mean.groupBy(by).agg(print_.alias("_m"), F.max("n").alias("n")).select(by, normalize(F.col("_m")).alias("voiceprint"), "n")


#: Voiceprints that blocks are drawn around, at most.
PIVOTS = 1024
#: Angles are known to so much.
_SLACK = 1e-6


def impostors(clusters: DataFrame, voiceprints: DataFrame, key: str, doctor: str = "doctor", vector: str = "embedding", voiceprint: str = "voiceprint") -> DataFrame:
    """(key, doctor, impostor): the greatest cosine of each cluster of a doctor (key, doctor, vector) to a voiceprint (doctor, voiceprint) of another doctor; null if there is none.

    Some voiceprints are pivots; every voiceprint is in the block of its nearest one, whose radius is the greatest angle in it. A cluster is compared with the voiceprints of those blocks that, by the
    triangle inequality, may hold one as near as the nearest pivot of another doctor. Clusters without a doctor, and vectors that are null or of length zero, are like no one. Keys are not null and stand once.
    """
    unit = lambda v: F.when(dot(v, v) > 0, normalize(v))
    prints = checkpointed(voiceprints.select(F.col(doctor).cast("string").alias("_other"), unit(F.col(voiceprint)).alias("_v")).where("_other IS NOT NULL AND _v IS NOT NULL"))
    count = prints.count()
    rows = prints.orderBy(F.xxhash64("_other"), "_other").limit(min(PIVOTS, math.ceil(math.sqrt(count)))).collect()  # at most PIVOTS
    if not rows:
        return clusters.select(key, doctor, F.lit(None).cast("double").alias("impostor"))
    pivots, names = np.array([r["_v"] for r in rows]), np.array([r["_other"] for r in rows], dtype=object)

    def angles(vectors: pd.Series) -> np.ndarray:
        return np.arccos(np.clip(np.array(vectors.tolist(), dtype=np.float64).reshape(-1, pivots.shape[1]) @ pivots.T, -1, 1))

    @F.pandas_udf("block int, angle double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        a = angles(vectors)
        return pd.DataFrame({"block": a.argmin(axis=1), "angle": a.min(axis=1, initial=np.inf)})

    blocks = checkpointed(prints.withColumn("_n", nearest("_v")).select("_other", "_v", F.col("_n.block").alias("_block"), F.col("_n.angle").alias("_angle")))
    radius = np.full(len(rows), -np.inf)
    for r in blocks.groupBy("_block").agg(F.max("_angle").alias("r")).collect():  # one row a pivot
        radius[r["_block"]] = r["r"]

    @F.pandas_udf("array<int>")
    def reached(vectors: pd.Series, own: pd.Series) -> pd.Series:
        a = angles(vectors)
        nearest_other = np.where(names[None, :] == own.to_numpy(dtype=object)[:, None], np.pi, a).min(axis=1, initial=np.pi)
        return pd.Series([np.flatnonzero(x) for x in a - radius <= nearest_other[:, None] + _SLACK], dtype=object)

    asked = clusters.select(key, doctor, F.col(doctor).cast("string").alias("_own"), unit(F.col(vector)).alias("_u"))
    usable = asked.where("_own IS NOT NULL AND _u IS NOT NULL")
    met = usable.withColumn("_block", F.explode(reached("_u", "_own"))).join(blocks.drop("_angle"), "_block").where("_own <> _other")
    best = met.groupBy(key).agg(F.max(dot(F.col("_u"), F.col("_v"))).alias("impostor"))
    return asked.select(key, doctor).join(best, key, "left")


def label_clusters(clusters: DataFrame, voiceprint: DataFrame, threshold: float = K.DOCTOR_THRESHOLD, min_share: float = K.MIN_SHARE, key: str | None = None) -> DataFrame:
    """Clusters (cluster, embedding, seconds, and key if several recordings) with similarity, share of speech and label.

    A cluster like the voiceprint is the doctor's, one of a small share is contamination, any other is other. ``voiceprint`` has one row.
    """
    total = clusters.groupBy(*([key] if key else [])).agg(F.sum("seconds").alias("_total"))
    df = clusters.join(broadcast_if_small(checkpointed(total)), key) if key else clusters.crossJoin(F.broadcast(total))  # one row
    df = df.crossJoin(F.broadcast(voiceprint.select(F.col("voiceprint").alias("_v")).limit(1)))
    df = df.withColumn("similarity", cosine(F.col("embedding"), F.col("_v"))).withColumn("share", F.col("seconds") / F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total")))
    label = F.when(F.col("similarity") >= threshold, "doctor").when(F.col("share") < min_share, "contamination").otherwise("other")
    return df.withColumn("label", label).drop("_v", "_total")


def label_turns(turns: DataFrame, decisions: DataFrame, threshold: float = K.DOCTOR_THRESHOLD) -> DataFrame:
    """Turns (cluster, similarity or null) with a label: their own where the similarity is known, save that contamination stays; else the cluster's. Turns of unknown clusters are left out."""
    parent = decisions.select("cluster", F.col("label").alias("_label"))
    label = F.when(F.col("similarity").isNull(), F.col("_label")).when(F.col("similarity") >= threshold, "doctor").when(F.col("_label") == "contamination", "contamination").otherwise("other")
    return turns.join(parent, "cluster").withColumn("label", label).drop("_label")


def score(ref: DataFrame, hyp: DataFrame, decisions: DataFrame, collar_ms: int = K.COLLAR_MS, key: str = "conv_id") -> DataFrame:
    """doctor_recall, doctor_precision, contamination_kept and conversation_dropped per recording, by time. ``decisions``: key, speaker, label."""
    labelled = hyp.withColumn("speaker", F.col("speaker").cast("string")).join(decisions.select(key, F.col("speaker").cast("string").alias("speaker"), "label"), [key, "speaker"], "left")
    cells = elementary_intervals(ref.withColumn("speaker", F.col("role")), labelled.withColumn("speaker", F.coalesce("label", F.lit("?"))), collar_ms, key)
    roles, labels = F.col("ref"), F.filter("hyp", lambda x: x != "?")
    has = F.array_contains
    kept = F.arrays_overlap(labels, F.array(F.lit("doctor"), F.lit("other")))
    share = lambda num, den: F.try_divide(F.sum(F.when(num & den, F.col("frames")).otherwise(0)), F.sum(F.when(den, F.col("frames"))))
    return cells.groupBy(key).agg(
        share(has(labels, "doctor"), has(roles, "doctor")).alias("doctor_recall"),
        share(has(roles, "doctor"), has(labels, "doctor")).alias("doctor_precision"),
        share(kept, has(roles, "contamination") & (F.size(roles) == 1)).alias("contamination_kept"),
        share((F.size(labels) > 0) & ~kept, F.size(F.array_except(roles, F.array(F.lit("contamination")))) > 0).alias("conversation_dropped"),
    )


def majority_roles(ref: DataFrame, hyp: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, speaker, role): the true role that each cluster overlaps longest, the first by name of equals."""
    cells = elementary_intervals(ref.withColumn("speaker", F.col("role")), hyp, 0, key)
    time = cells.select(key, "frames", "ref", F.explode("hyp").alias("speaker")).select(key, "frames", "speaker", F.explode("ref").alias("role")).groupBy(key, "speaker", "role").agg(F.sum("frames").alias("f"))
    return time.groupBy(key, "speaker").agg(F.min(F.struct((-F.col("f")).alias("f"), "role"))["role"].alias("role"))


def similarity_margin(decisions: DataFrame, roles: DataFrame, key: str = "conv_id") -> DataFrame:
    """Least similarity of the doctor's clusters less the greatest of the rest; null if either is missing."""
    doctor = F.col("role") == "doctor"
    margin = F.min(F.when(doctor, F.col("similarity"))) - F.max(F.when(~doctor, F.col("similarity")))
    return decisions.withColumn("speaker", F.col("speaker").cast("string")).join(roles, [key, "speaker"]).groupBy(key).agg(margin.alias("margin"))
