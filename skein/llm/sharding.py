"""Sharding by extendible hashing.

A document's place is given by the bits of a digest. The directory starts from one
shard; a shard over the byte limit is split on its next bit, and only that one, until
every shard fits. The directory comes from sums over hash prefixes: one pass gives
the sums at a depth at which most prefixes fit, the sums of all shorter prefixes
follow from those, and a shard is the shortest prefix that fits. Prefixes that are
still over the limit, such as around a very long document, take a further, deeper pass
over their own documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import broadcast_if_small, checkpointed, table
from skein.llm.mixing import identity

BITS = 60
#: Bits looked at beyond those that equal shards would need, and by each further pass.
STEP = 6
#: Limit of a shard's text.
SHARD_BYTES = 1 << 20


def _prefix(depth: int):
    return F.shiftright("_h", BITS - depth)


def _leaves(rows: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """(_bucket, _shard) for each prefix of ``depth`` bits: the shortest prefix over ``above`` bits that fits or can't be split, null if none does.

    Depths are taken STEP at a time from the deepest up, and the sums of each step roll up to the next, which has up to 64 times fewer rows:
    a bucket is looked at STEP times and not once a depth, and no prefix of a step has more than 64 buckets. A prefix that fits above wins.
    """
    sums = [F.sum("_b").alias("_b"), F.sum("_n").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]
    sized = rows.groupBy(_prefix(depth).alias("_bucket")).agg(F.sum("n_bytes").alias("_b"), F.count("*").alias("_n"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    steps = []
    while True:
        sized, low = checkpointed(sized), max(above, depth - STEP + 1)
        spread = sized.withColumn("_d", F.explode(F.sequence(F.lit(low), F.lit(depth)))).withColumn("_p", F.expr(f"shiftright(_bucket, {depth} - _d)"))
        fit = spread.groupBy("_d", "_p").agg(*sums).where((F.col("_b") <= limit) | (F.col("_lo") == F.col("_hi"))).select("_d", "_p", F.col("_b").alias("_sb"), F.col("_n").alias("_sn"))
        found = spread.select("_bucket", "_d", "_p").join(fit, ["_d", "_p"]).groupBy("_bucket").agg(F.min(F.struct("_d", "_p", "_sb", "_sn")).alias("_shard"))
        steps.append((sized.select("_bucket").join(found, "_bucket", "left"), depth - low + 1))
        if low == above:
            break
        sized = sized.groupBy(F.shiftright("_bucket", depth - low + 1).alias("_bucket")).agg(*sums)
        depth = low - 1
    leaves, _ = steps.pop()
    while steps:
        own, bits = steps.pop()
        upper = leaves.select(F.col("_bucket").alias("_up"), F.col("_shard").alias("_upper"))
        leaves = own.join(upper, F.shiftright("_bucket", bits) == F.col("_up")).select("_bucket", F.coalesce("_upper", "_shard").alias("_shard"))
    return checkpointed(leaves)


def shard(docs: DataFrame, *, byte_limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes, shard (its prefix as 0s and 1s), depth, shard_bytes, shard_docs and oversized.

    No shard's texts exceed ``byte_limit`` bytes of UTF-8, save one that cannot be split: a single
    longer document, or rows that are equal in id and text, which share their digest; ``oversized`` marks it. A null text
    has no bytes; a null id counts as an empty one. The single shard of a small table has the empty prefix. ``keep``
    names the input columns to return; one named like a result column gives way to it. An empty
    table gives an empty one.
    """
    own = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in own]
    text = F.col(text_col).cast("string")
    h = F.conv(F.substring(identity(F.col(id_col), text), 1, BITS // 4), 16, 10).cast("long")
    keyed = docs.select(h.alias("_h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), *[F.col(c).alias(f"_in_{c}") for c in kept])
    rows = checkpointed(keyed) if set(kept) <= {id_col} else keyed
    slim = rows if rows is not keyed else checkpointed(keyed.select("_h", "n_bytes"))
    total = slim.agg(F.sum("n_bytes")).first()[0] or 0
    depth, above, open_rows = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / byte_limit)))) + STEP), 0, slim
    out = rows.withColumn("_shard", F.lit(None).cast("struct<_d:int,_p:bigint,_sb:bigint,_sn:bigint>"))
    while True:
        leaves = _leaves(open_rows, above, depth, byte_limit)
        at = broadcast_if_small(leaves.withColumnRenamed("_shard", "_found"))
        out = out.withColumn("_bucket", _prefix(depth)).join(at, "_bucket", "left").withColumn("_shard", F.coalesce("_shard", "_found")).drop("_bucket", "_found")
        still = leaves.where("_shard IS NULL").select("_bucket")
        if depth == BITS or still.isEmpty():
            break
        open_rows = checkpointed(open_rows.withColumn("_bucket", _prefix(depth)).join(broadcast_if_small(still), "_bucket").select("_h", "n_bytes"))
        above, depth = depth + 1, min(BITS, depth + STEP)
    d = F.col("_shard._d")
    bits = F.when(d == 0, F.lit("")).otherwise(F.lpad(F.bin(F.col("_shard._p")), d, "0"))
    return out.select(
        *[F.col(f"_in_{c}").alias(c) for c in kept], "n_bytes", bits.alias("shard"), d.alias("depth"), F.col("_shard._sb").alias("shard_bytes"),
        F.col("_shard._sn").alias("shard_docs"), (F.col("_shard._sb") > byte_limit).alias("oversized"),
    )


def op5_shard(spark, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return shard(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs", "oversized")


ORACLE_OP5 = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(concat_ws(chr(31), doc_id::VARCHAR, text)), 1, 15))::BIGINT AS h FROM documents
), e AS (
  SELECT *, unnest(range(0, {BITS + 1}))::INT AS depth FROM d
), s AS (
  SELECT *, h >> ({BITS} - depth) AS p, sum(n_bytes) OVER w AS b, count(*) OVER w AS n, min(h) OVER w = max(h) OVER w AS one FROM e WINDOW w AS (PARTITION BY depth, h >> ({BITS} - depth))
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, h ORDER BY depth) AS k FROM s WHERE b <= {SHARD_BYTES} OR one
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard, depth, b::BIGINT AS shard_bytes, n::BIGINT AS shard_docs, b > {SHARD_BYTES} AS oversized
FROM f WHERE k = 1
"""
