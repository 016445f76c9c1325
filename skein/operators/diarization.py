"""Diarization scores without a frame grid.

Scores are sampled at frame middles, every 10 ms. Between two neighbouring boundaries
the active speakers don't change, so each elementary interval counts once, weighted with
the number of frame middles in it. The intervals come from a union of all
boundaries and a window per recording; who is active, from a running sum per speaker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.shared import checkpointed

#: Width of the bins that bring an interval's start and the spells that hold it together.
BIN_MS = 60_000


def elementary_intervals(ref: DataFrame, hyp: DataFrame, collar_ms: int = K.COLLAR_MS, key: str = "conv_id") -> DataFrame:
    """(key, ref, hyp, roles, frames): sets of the speakers active over a number of frames, and of the true roles; frames within the collar of a true boundary are left out.

    ``ref`` and ``hyp`` have key, speaker, start_ms and end_ms; ``ref`` may have a role. Intervals of no length are left out.
    """
    ref = ref.where("end_ms > start_ms")
    hyp = hyp.where("end_ms > start_ms")
    role = F.col("role") if "role" in ref.columns else F.lit(None).cast("string")
    turn = lambda df, side, role: df.select(key, F.lit(side).alias("side"), F.col("speaker").cast("string").alias("speaker"), role.alias("role"), "start_ms", "end_ms")
    turns = turn(ref, "r", role).unionByName(turn(hyp, "h", F.lit(None).cast("string")))
    edges = turns.select(key, F.explode(F.array("start_ms", "end_ms")).alias("at"))
    points = edges
    if collar_ms:
        b = ref.select(key, F.explode(F.array("start_ms", "end_ms")).alias("b"))
        collars = b.select(key, (F.col("b") - collar_ms + 1).alias("start_ms"), (F.col("b") + collar_ms).alias("end_ms"))
        turns = turns.unionByName(collars.select(key, F.lit("c").alias("side"), F.lit("").alias("speaker"), F.lit(None).cast("string").alias("role"), "start_ms", "end_ms"))
        points = edges.union(collars.select(key, F.explode(F.array("start_ms", "end_ms"))))
    last = edges.groupBy(key).agg((F.bround(F.max("at") / K.FRAME_MS) * K.FRAME_MS).cast("long").alias("cap"))
    w = Window.partitionBy(key).orderBy("at")
    cuts = points.where("at > 0").union(last.select(key, F.lit(0).cast("long"))).distinct().withColumn("until", F.lead("at").over(w)).where("until IS NOT NULL").join(last, key)
    half = K.FRAME_MS // 2
    frames = lambda x: F.ceil((F.least(F.col(x), F.col("cap")) - half) / K.FRAME_MS)
    cuts = cuts.withColumn("frames", frames("until") - frames("at")).where("frames > 0").select(key, "at", "frames")
    # the running sets: +1 where a turn starts, -1 where it ends
    change = turns.select(key, "side", "speaker", "role", F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_ms").alias("at"), F.lit(-1).alias("d")))).alias("_e"))
    change = change.groupBy(key, "side", "speaker", "role", F.col("_e.at").alias("at")).agg(F.sum("_e.d").alias("d"))
    running = Window.partitionBy(key, "side", "speaker", "role").orderBy("at")
    state = change.withColumn("n", F.sum("d").over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("until", F.lead("at").over(running))
    spells = state.where("n > 0").select(key, "side", "speaker", "role", F.col("at").alias("start_ms"), F.col("until").alias("end_ms"))
    # a cut meets the spells that hold it in its own time bin
    spells = spells.withColumn("_bin", F.explode(F.expr(f"sequence(start_ms div {BIN_MS}, (end_ms - 1) div {BIN_MS})"))).alias("s")
    on = (F.col(f"c.{key}") == F.col(f"s.{key}")) & (F.col("c._bin") == F.col("s._bin")) & (F.col("s.start_ms") <= F.col("c.at")) & (F.col("s.end_ms") > F.col("c.at"))
    held = cuts.withColumn("_bin", F.expr(f"at div {BIN_MS}")).alias("c").join(spells, on)
    side = lambda x: F.sort_array(F.collect_set(F.when(F.col("s.side") == x, F.col("s.speaker")))).alias({"r": "ref", "h": "hyp"}[x])
    out = held.groupBy(F.col(f"c.{key}").alias(key), "c.at", "c.frames").agg(side("r"), side("h"), F.sort_array(F.collect_set("s.role")).alias("roles"), F.bool_or(F.col("s.side") == "c").alias("_near"))
    return out.where("NOT _near").drop("_near").withColumnRenamed("at", "at_ms")


def heaviest_pairs(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a row and a column, each used once at most, of the greatest total weight; pairs without weight are left out.

    Rows enter one after another, each along a shortest augmenting path; prices of rows and columns keep all costs at zero or more.
    """
    n, m = weights.shape
    gain = np.hstack([weights.astype(float), np.zeros((n, n))])  # a column of its own for each row that stays alone
    cost = gain.max(initial=0.0) - gain
    owner, row_price, column_price = np.full(m + n, -1), np.zeros(n), np.zeros(m + n)
    for start in range(n):
        distance, came, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        row, column, reached = start, -1, 0.0
        while row >= 0:
            along = reached + cost[row] - row_price[row] - column_price
            nearer = ~done & (along < distance)
            distance[nearer], came[nearer] = along[nearer], column
            column = int(np.argmin(np.where(done, np.inf, distance)))
            reached, done[column], row = distance[column], True, owner[column]
        tree = done & (owner >= 0)
        row_price[start] += reached
        row_price[owner[tree]] += reached - distance[tree]
        column_price[tree] -= reached - distance[tree]
        while column >= 0:
            before = came[column]
            owner[column] = owner[before] if before >= 0 else start
            column = before
    return [(int(owner[c]), c) for c in range(m) if owner[c] >= 0 and weights[owner[c], c] > 0]


def falling_pairs(weights: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by falling weight, each row and column used once; of equal weights the first row, then the first column."""
    left, pairs = weights.copy(), []
    while left.size and left.max() > 0:
        r, h = map(int, np.unravel_index(np.argmax(left), left.shape))
        pairs.append((r, h))
        left[r, :] = left[:, h] = 0
    return pairs


def overlap_matrix(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted ref, sorted hyp, frames of each pair of them) of rows (ref, hyp, frames)."""
    refs, rows = np.unique(group["ref"].to_numpy(), return_inverse=True)
    hyps, columns = np.unique(group["hyp"].to_numpy(), return_inverse=True)
    weights = np.zeros((len(refs), len(hyps)), dtype=group["frames"].dtype)
    np.add.at(weights, (rows, columns), group["frames"].to_numpy())
    return refs, hyps, weights


def best_mapping(overlaps: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, ref, hyp): the one-to-one mapping of speakers with the greatest total overlap, from (key, ref, hyp, frames).

    Exact up to fifteen speakers of the hypothesis; beyond, pairs are taken by falling overlap. One recording's matrix
    of speakers is a group.
    """

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        refs, hyps, weights = overlap_matrix(group)
        pairs = (falling_pairs if len(hyps) > K.EXACT_SPEAKERS else heaviest_pairs)(weights)
        return pd.DataFrame({key: group[key].iloc[0], "ref": [refs[r] for r, _ in pairs], "hyp": [hyps[h] for _, h in pairs]}).astype({"ref": object, "hyp": object})

    kind = overlaps.schema[key].dataType.simpleString()
    return overlaps.select(key, "ref", "hyp", "frames").groupBy(key).applyInPandas(assign, f"{key} {kind}, ref string, hyp string")


def error_rate(ref: DataFrame, hyp: DataFrame, collar_ms: int = K.COLLAR_MS, key: str = "conv_id") -> DataFrame:
    """Per recording: der, missed, false_alarm, confusion, scored (seconds), overlap_recall, role_purity, ref_speakers, hyp_speakers."""
    cells = checkpointed(elementary_intervals(ref, hyp, collar_ms, key))  # read three times
    matrix = cells.select(key, "frames", "hyp", F.explode("ref").alias("r")).select(key, "frames", F.col("r").alias("ref"), F.explode("hyp").alias("hyp")).groupBy(key, "ref", "hyp").agg(F.sum("frames").alias("frames"))
    mapped = best_mapping(matrix, key).join(matrix, [key, "ref", "hyp"]).groupBy(key).agg(F.sum("frames").alias("correct"))
    nr, nh, f = F.size("ref"), F.size("hyp"), F.col("frames")
    sums = cells.groupBy(key).agg(
        F.sum(F.greatest(F.lit(0), nr - nh) * f).alias("missed"), F.sum(F.greatest(F.lit(0), nh - nr) * f).alias("false_alarm"), F.sum(F.least(nr, nh) * f).alias("both"), F.sum(nr * f).alias("scored"),
        F.sum(F.when(nr >= 2, f)).alias("overlap"), F.sum(F.when((nr >= 2) & (nh >= 2), f)).alias("found"),
    )
    roles = cells.where((F.size("ref") == 1) & (F.size("roles") == 1)).select(key, "frames", F.explode("hyp").alias("hyp"), F.element_at("roles", 1).alias("role"))
    roles = roles.groupBy(key, "hyp", "role").agg(F.sum("frames").alias("f")).groupBy(key, "hyp").agg(F.max("f").alias("most"), F.sum("f").alias("all"))
    purity = roles.groupBy(key).agg((F.sum("most") / F.sum("all")).alias("role_purity"))
    spoke = lambda df, name: df.where("end_ms > start_ms").groupBy(key).agg(F.count_distinct("speaker").alias(name))
    df = spoke(ref, "ref_speakers").join(spoke(hyp, "hyp_speakers"), key, "full").join(sums, key, "left").join(mapped, key, "left").join(purity, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    df = df.withColumn("confusion", zero("both") - zero("correct"))
    seconds = lambda c: F.bround(zero(c) * (K.FRAME_MS / 1000), 3).alias(c)
    return df.select(
        key, F.when(zero("scored") > 0, (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.col("scored")).alias("der"), seconds("missed"), seconds("false_alarm"), seconds("confusion"), seconds("scored"),
        F.try_divide(zero("found"), "overlap").alias("overlap_recall"), "role_purity", zero("ref_speakers").alias("ref_speakers"), zero("hyp_speakers").alias("hyp_speakers"),
    )
