"""Mixing sources to target weights.

Efraimidis-Spirakis sampling without replacement: a document gets the
exponential key -ln(u) / weight, where u comes from a digest of its id and text
and weight is its quality. Within a source the documents are taken by rising
key until their sizes reach the source's token budget. A budget over the
source's own size is met by complete epochs first; the keys decide the rest.

No source is sorted as a whole. A histogram of the keys finds the bin in which
the budget ends, that bin is split again while it is large, and only the rows of
the last bin are sorted. What remains is one cut per source, so the documents
themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.shared import broadcast_if_small, checkpointed, table

#: Runs of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
BINS = 512
#: Rows of the bin in which a budget ends that may be sorted by one task.
SORT_ROWS = 2_000
MAX_ROUNDS = 12


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_quality(text: Column) -> Column:
    """Quality weight from 0.25 to 1: it rises with the share of letters among the characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.lit(0.25) + F.lit(0.75) * F.coalesce(letters / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def identity(doc_id: Column, text: Column) -> Column:
    """Digest of id and text; equal rows have equal ones."""
    return F.md5(F.concat_ws("\x1f", doc_id.cast("string"), text).cast("binary"))


def exponential_key(digest: Column, weight: Column) -> Column:
    """-ln(u) / weight with u from the first 52 bits of the digest."""
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def source_key(source: Column) -> Column:
    """A key that is never null and keeps a null source apart from every text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Token budget of each source. ``sizes`` has a row per source: _key, _source, source_size.

    The budgets share the sum of all sizes by weight. None exceeds ``max_repeat``
    times its source's size; what is cut off goes to the others by weight. With
    the sources sorted by the level at which they reach their limit, the final
    level is the first one that lies under the limit of its own source, which is also
    the highest such level, so no iteration is needed. The windows run over one row per source.
    """
    everything = Window.partitionBy()
    rank = Window.orderBy(F.col("_source").asc_nulls_last(), "_key")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * float(max_repeat))
    df = df.withColumn("_at", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_at", "_key").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    df = df.withColumn("_level", level)
    final = F.max(F.when(F.col("_level") <= F.col("_at"), F.col("_level"))).over(everything)
    return df.withColumn("target", F.least("_cap", final * F.col("_w"))).drop("_w", "_cap", "_at", "_level")


def _cuts(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """For each source its epochs and the last (key, digest) that the rest of its budget takes."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("_epochs", epochs)
    plan = plan.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    bounds = keyed.groupBy("_key").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"), F.count("*").alias("_n"))
    plan = checkpointed(plan.join(bounds, "_key").withColumn("_base", F.lit(0).cast("long")))
    small = broadcast_if_small(plan)
    inside = F.col("_k").between(F.col("_lo"), F.col("_hi"))
    for _ in range(MAX_ROUNDS):
        if plan.where((F.col("_n") > SORT_ROWS) & (F.col("_lo") < F.col("_hi"))).isEmpty():
            break
        span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
        bins = F.least(F.floor((F.col("_k") - F.col("_lo")) / span * BINS), F.lit(BINS - 1))
        held = (
            keyed.join(small.select("_key", "_lo", "_hi"), "_key")
            .where(inside)
            .groupBy("_key", bins.alias("_bin"))
            .agg(F.sum("size").alias("_size"), F.count("*").alias("_in"), F.min("_k").alias("_blo"), F.max("_k").alias("_bhi"))
        )
        w = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cum = held.withColumn("_cum", F.sum("_size").over(w)).join(small.select("_key", "_base", "_rest"), "_key")
        at = cum.where(F.col("_base") + F.col("_cum") >= F.col("_rest")).groupBy("_key").agg(
            F.min(F.struct("_bin", "_blo", "_bhi", "_in", (F.col("_base") + F.col("_cum") - F.col("_size")).alias("_new"))).alias("_b")
        )
        plan = checkpointed(
            plan.drop("_lo", "_hi", "_n", "_base").join(at, "_key").select(
                *[c for c in plan.columns if c not in ("_lo", "_hi", "_n", "_base")],
                F.col("_b._blo").alias("_lo"), F.col("_b._bhi").alias("_hi"), F.col("_b._in").alias("_n"), F.col("_b._new").alias("_base"),
            )
        )
        small = broadcast_if_small(plan)
    # rows of one key and digest are equal rows and share one decision
    peers = keyed.join(small.select("_key", "_lo", "_hi", "_base", "_rest"), "_key").where(inside)
    peers = peers.groupBy("_key", "_k", "_digest", "_base", "_rest").agg(F.sum("size").alias("_size"))
    w = Window.partitionBy("_key").orderBy("_k", "_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_base") + F.sum("_size").over(w)
    cut = (
        peers.withColumn("_mid", upto - F.col("_size") / 2.0)
        .where(F.col("_mid") <= F.col("_rest"))
        .groupBy("_key")
        .agg(F.max(F.struct("_k", "_digest")).alias("_cut"))
    )
    return checkpointed(plan.join(cut, "_key", "left").drop("_n", "_base", "_hi", "_rest"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(5, 2, 1),
    max_repeat: int = 3,
    quality: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix takes the document) and taken.

    ``keep`` names the input columns to return (all by default); an input column with
    the name of a result column gives way to it. ``quality`` must be positive.

    A null text has size 0 and no quality beyond the least. A null source is a source
    of its own, behind the others. A null id counts as an empty one. Equal rows share
    one decision. Of a source the mix takes its epochs and then the documents whose
    middle lies within the rest of the budget, so it misses the target by at most half
    the document on the border; no document is taken more than ``max_repeat`` times. An empty table gives an empty one.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    text = F.col(text_col)
    weight = letter_quality(text) if quality is None else quality
    digest = identity(F.col(id_col), text)
    keyed = docs.select(
        source_key(F.col(source_col)).alias("_key"), F.col(source_col).cast("string").alias("_source"), word_count(text).alias("size"),
        digest.alias("_digest"), exponential_key(digest, weight).alias("_k"), *[F.col(c).alias(f"_in_{c}") for c in kept],
    )
    light = {id_col, source_col} >= set(kept)
    rows = checkpointed(keyed) if light else keyed
    sums = rows if light else checkpointed(keyed.select("_key", "_source", "size", "_digest", "_k"))
    sizes = checkpointed(sums.groupBy("_key", "_source").agg(F.sum("size").alias("source_size")))
    plan = broadcast_if_small(_cuts(sums.drop("_source"), source_targets(sizes, weights, max_repeat)).drop("_source"))
    k, d = F.col("_k"), F.col("_digest")
    chosen = (k < F.col("_lo")) | F.coalesce((k < F.col("_cut._k")) | ((k == F.col("_cut._k")) & (d <= F.col("_cut._digest"))), F.lit(False))
    # a document without words that comes first would be chosen even where nothing is left of the budget
    copies = F.least(F.col("_epochs") + F.when(chosen, 1).otherwise(0), F.lit(max_repeat)).cast("long")
    out = rows.join(plan, "_key").withColumn("copies", copies)
    return out.select(
        *[F.col(f"_in_{c}").alias(c) for c in kept], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: words taken from each against its source's target."""
    out = mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE_OP1 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat_ws(chr(31), doc_id::VARCHAR, text)) AS digest,
    0.25::DOUBLE + 0.75::DOUBLE * coalesce(length(regexp_replace(text, '[^\p{L}]', '', 'g'))::DOUBLE / greatest(length(text), 1)::DOUBLE, 0.0::DOUBLE) AS weight
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s
), a AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS cap_w FROM r
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap_w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap_w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a
), t AS (
  SELECT source, source_size, least(cap, w * max(CASE WHEN level <= cap_w THEN level END) OVER ()) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t
), k AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight, digest) - d.size / 2.0 AS mid
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, ((epochs + CASE WHEN mid <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM k
"""
