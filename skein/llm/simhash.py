"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, Hamming distance, components.

Fingerprints are cut into ``blocks`` parts. Two of them that differ in at most d
bits agree in at least ``blocks`` - d parts, so every such pair shares the value of
one choice of that many parts. Equal fingerprints are one row before the join, so
exact copies never meet each other. A block value that many fingerprints share
would bring all their pairs together; such fingerprints get links another exact
way instead: each emits itself and its 64 one-bit neighbours, and two fingerprints
differ in at most two bits if and only if they emit a common value. At most 65
distinct fingerprints emit one value, and all of them are within two bits of each
other, so a link to the smallest is enough.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.shared import bound_batches, broadcast_if_small, checkpointed, table
from skein.llm.components import connected_components

SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
#: Bits of 64 by which the fingerprints of edited copies may differ on average; as measured, texts whose
#: five-word shingles have a Jaccard similarity of 0.8 differ in 7.
SPREAD = 7.75
#: The same for fingerprints of five-word shingles: at 0.8 they differ in 9.7 bits, 64 * acos(2 * 0.8 / 1.8) / pi, give or take one.
SPREAD_FIVE = 11.5
#: Fingerprints that may share a block value and still be joined in pairs.
PAIRED = 64
#: Texts that are compared with as many others in one go.
BLOCK = 1024
#: Comparisons of texts in whole components that may take the place of one within a key.
PER_ROW = 64
#: One in so many keys is looked at before all of them.
_STEP = 14
_SLICE = 1 << 16


def fingerprints(data: bytes | None, shingle: int = SHINGLE, count: int = 1) -> list[int]:
    """``count`` 64-bit SimHashes, as signed integers, of a text's word shingles; 0 for a text without words.

    ASCII letters are lower-cased and words end at ASCII white space. A shingle's hash is its XXH64 with seed 42; a
    bit is set if more than half the hashes set it. Further fingerprints are taken from the same hashes, mixed anew.
    """
    words = data.lower().split() if data else ()
    if not words:
        return [0] * count
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([hashed(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, stops)), dtype=np.uint64, count=len(starts))
    set_bits = np.zeros((count, 64), dtype=np.int64)
    for k in range(0, len(hashes), _SLICE):
        part = hashes[k : k + _SLICE]
        for n in range(count):
            mixed = np.ascontiguousarray(_mixed(part, n) if n else part)
            set_bits[n] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(hashes), axis=1, bitorder="little").view(np.int64)[:, 0].tolist()


def _mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """Another hash of each hash, by the finalizer of a common 64-bit generator."""
    x = hashes ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE, count: int = 1, into: str = "_fps") -> DataFrame:
    bound_batches(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprints(x, shingle, count) for x in batch], dtype=object)

    return docs.withColumn(into, scan(F.col(text_col).cast("string").cast("binary")))


def _masks(blocks: int, agree: int) -> list[int]:
    """The bits of every choice of ``agree`` blocks, as signed 64-bit integers."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hamming_links(prints: DataFrame, blocks: int = BLOCKS, paired: int = PAIRED) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) of which the components are those of all pairs within two bits."""
    masks = _masks(blocks, blocks - DISTANCE)
    keys = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("x")) for i, m in enumerate(masks)])).alias("k"))
    keys = keys.select("fp", "k.g", "k.x")
    shared = checkpointed(keys.groupBy("g", "x").agg(F.count("*").alias("n")).where("n > 1"))
    met = checkpointed(keys.join(shared, ["g", "x"]))
    few = met.where(F.col("n") <= paired).select("g", "x", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["g", "x"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    flips = [0, *(1 << bit for bit in range(63)), -(1 << 63)]
    many = met.where(F.col("n") > paired).select("fp").distinct()
    balls = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("z"))
    balls = balls.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = balls.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.union(stars)


def _quarters(count: int) -> list[tuple[int, int, int]]:
    """(fingerprint, quarter of it, its bits) of every quarter of ``count`` fingerprints."""
    return [(v, i, m) for v in range(count) for i, m in enumerate(_masks(4, 1))]


def _key_quarters(count: int) -> list[tuple[int, int]]:
    """The two quarters of each key: every two of one fingerprint, and each with the next quarter of the next fingerprint and the one after that of the next but one."""
    within = [(4 * v + i, 4 * v + j) for v in range(count) for i, j in combinations(range(4), 2)]
    return within + [(4 * v + i, 4 * ((v + n) % count) + (i + n) % 4) for n in (1, 2) for v in range(count) for i in range(4) if n < count]


def similar_links(classes: DataFrame, count: int, known: DataFrame, spread: float = SPREAD, block: int = BLOCK, per_row: int = PER_ROW) -> DataFrame:
    """Links (a, b) between first fingerprints fp (fps: all ``count`` of a text; blocks: as many that keys are taken from, of the same or of shorter shingles) of which the components are those of ``known`` links (a, b) and all pairs of texts that share a key and differ in few bits of all fps together.

    Every pair of two quarters of one fingerprint is a key of 32 bits, and so is each quarter with one
    quarter of the next two fingerprints. No key is capped or split, and no pair of a key is left out but those that links have already
    brought into one component. Of each key only the texts outside of its largest component become rows. Each is compared
    with a few texts of that component, first over a few keys, then over all. Those that stay outside are compared with all texts of the component,
    of other keys too, once for all keys, and with all others that stay outside of it; where that takes over ``per_row`` comparisons for each that
    the keys themselves ask for, as with two large components that meet in a key by chance, the texts of each key are compared instead. Comparisons
    are part of the joins, so that only links leave them, and are cut into blocks of about ``block`` by ``block`` texts. Their number
    grows with the square of a family of texts that share keys and are all unlike. A pair shares a key with a probability that rises with its similarity.
    """
    vectors = checkpointed(classes.select("fp", "fps", "blocks", F.xxhash64("fps", "blocks").alias("v")).distinct())
    quarter = [F.get("blocks", F.lit(v)).bitwiseAND(F.lit(m)) for v, _, m in _quarters(count)]
    parts = [F.xxhash64(F.lit(n), quarter[i], quarter[j]) for n, (i, j) in enumerate(_key_quarters(count))]
    bits = sum((F.bit_count(F.get("a_fps", F.lit(i)).bitwiseXOR(F.get("b_fps", F.lit(i)))) for i in range(count)), F.lit(0))
    alike = (F.col("ac") != F.col("bc")) & (bits <= spread * count)
    side = lambda x: named.select(F.col("v").alias(x), F.col("c").alias(f"{x}c"), F.col("fps").alias(f"{x}_fps"))
    between = lambda met: met.select(F.col("ac").alias("a"), F.col("bc").alias("b"))

    def linked(links: DataFrame) -> DataFrame:
        """Texts with the component c, which is one of its fingerprints, after further links between components."""
        names = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("_c"))
        return checkpointed(named.join(names, "c", "left").withColumn("c", F.coalesce("_c", "c")).drop("_c"))

    def outside(some: list[Column]) -> DataFrame:
        """Texts with each component (top) that is the largest of one of their keys and not their own: a few of its texts there, the keys, and its texts in them."""
        keys = named.select("v", "c", F.explode(F.array(*some)).alias("k")).repartition("k")
        sizes = keys.groupBy("k", "c").agg(F.count("*").alias("s"), F.min("v").alias("one")).groupBy("k").agg(F.count("*").alias("n"), F.max(F.struct("s", "c", "one")).alias("top")).where("n > 1")
        rows = keys.join(sizes, "k").where("c <> top.c").select("k", "v", "top.*").withColumnRenamed("c", "top")
        ones = F.array_distinct(F.array(F.max_by("one", "s"), F.min_by("one", F.xxhash64("k", F.lit(1))), F.min_by("one", F.xxhash64("k", F.lit(2)))))
        return checkpointed(rows.groupBy("v", "top").agg(ones.alias("ones"), F.count("*").alias("shared"), F.sum("s").alias("held")))

    named = vectors.withColumn("c", F.col("fp"))
    named = linked(known)
    for some in (parts[::_STEP], parts):
        pairs = outside(some)
        star = pairs.select(F.explode("ones").alias("a"), F.col("v").alias("b")).join(side("a"), "a").join(side("b"), "b").where(alike)
        named = linked(between(star))
    names = named.select(F.col("fp").alias("top"), F.col("c").alias("_top")).distinct()
    pairs = pairs.join(named.select("v", "c"), "v").join(names, "top").where("c <> _top").groupBy("v", F.col("_top").alias("top")).agg(F.sum("shared").alias("shared"), F.sum("held").alias("held"))
    tops = pairs.groupBy("top").agg(F.count("*").alias("rest"), F.sum("shared").alias("keys")).join(named.groupBy(F.col("c").alias("top")).agg(F.count("*").alias("n")), "top")
    pairs = pairs.join(tops, "top").where("n > 1 OR rest > 1")  # a single text was compared above
    pairs = pairs.select("v", "top", "n", "rest", (F.col("n") <= per_row * F.col("held")).alias("whole"), (F.col("rest").cast("double") * F.col("rest") <= per_row * F.col("keys")).alias("others"))
    pairs = checkpointed(pairs)
    # a and b meet by x: a component and the texts outside of it, these among themselves, or a key
    by = lambda *x: F.xxhash64(*x).alias("x")
    one, other = F.lit(1).alias("first"), F.lit(0).alias("first")
    both = F.explode(F.array(F.lit(1), F.lit(0))).alias("first")
    whole = pairs.where("whole AND n > 1")
    sides = [pairs.where("others AND rest > 1").select(by("top", F.lit("others")), "v", both), whole.select(by("top", F.lit("whole")), "v", one)]
    sides.append(named.join(whole.select(F.col("top").alias("c")).distinct(), "c").select(by("c", F.lit("whole")), "v", other))
    left = pairs.where("NOT whole OR NOT others")
    if not left.isEmpty():
        left = checkpointed(left.join(named.select("v", "blocks"), "v").select("v", "top", "whole", "others", F.explode(F.array(*parts)).alias("k")))
        met = named.select("v", "c", F.explode(F.array(*parts)).alias("k")).join(broadcast_if_small(left.where("NOT whole").select("k", "top").distinct()), "k").where("c = top")
        met = checkpointed(met.select("k", "top", "v"))
        sides.append(left.where("NOT whole").join(met.select("k", "top").distinct(), ["k", "top"]).select(by("k", "top", F.lit("whole")), "v", one))
        sides.append(met.select(by("k", "top", F.lit("whole")), "v", other))
        sides.append(left.where("NOT others").select(by("k", F.lit("others")), "v").distinct().select("x", "v", both))
    # many short parts become as many as any other table has
    sides = checkpointed(reduce(DataFrame.union, sides).repartition("x", "v"))
    one, other = sides.where("first = 1").drop("first"), sides.where("first = 0").drop("first")
    grid = sides.groupBy("x").agg(F.sum("first").alias("n"), F.sum(1 - F.col("first")).alias("m")).where("n > 0 AND m > 0")
    cut = lambda n: F.ceil(F.col(n) / block).cast("long")
    grid = checkpointed(grid.select("x", cut("n").alias("n"), cut("m").alias("m")))
    place = lambda n: F.pmod(F.xxhash64("v", F.lit(0)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = one.join(grid, "x").select("x", F.col("v").alias("a"), place("n").alias("i"), every("m").alias("j")).join(side("a"), "a")
    b = other.join(grid, "x").select("x", F.col("v").alias("b"), place("m").alias("j"), every("n").alias("i")).join(side("b"), "b")
    last = between(a.join(b, ["x", "i", "j"]).where(alike))
    return named.select(F.col("c").alias("a"), F.col("fp").alias("b")).where("a <> b").union(last)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, count: int = 1, block_shingle: int | None = None, spread: float = SPREAD
) -> DataFrame:
    """(id, fp, component): a row per row of ``docs`` with its first fingerprint and the smallest id in reach over links.

    Two documents link if their first fingerprints are within two bits; every such pair is found. With a ``count`` over
    1 they also link if all their fingerprints together differ in at most ``spread`` bits each on average, which finds
    edited copies (see similar_links); pairs to compare then share blocks of fingerprints of ``block_shingle`` words, by default of the same ones. An edited
    word changes fewer short shingles than long ones, so short ones bring together more of the pairs whose long ones are alike. Null and empty texts have fingerprint 0 and are one group with all that come within
    two bits of it. Null ids are never a component's name unless it has no other. Repeated
    rows are copies like any others, and texts of one id are told apart. Other columns are not read, so none clashes. Very long texts
    are hashed in slices. An empty table gives an empty one.
    """
    return _grouped(docs, id_col, text_col, shingle, count, block_shingle, spread).select("id", "fp", "component")


def _digest(text_col: str) -> Column:
    return F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("string").cast("binary"), 256)), F.lit(b""))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, count: int, block_shingle: int | None, spread: float, digest: bool = False) -> DataFrame:
    """near_duplicates with the group, which unlike the component's name no other group has, and if wanted a digest of the text."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *([_digest(text_col).alias("digest")] if digest else []))
    kept = ["id", "digest"] if digest else ["id"]
    rows = with_fingerprints(text, "_text", shingle, count)
    if block_shingle:
        rows = with_fingerprints(rows, "_text", block_shingle, count, into="_blocks")
    rows = checkpointed(rows.select(*kept, F.element_at("_fps", 1).alias("fp"), *(["_fps"] if count > 1 else []), *(["_blocks"] if block_shingle else [])))
    classes = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    links = hamming_links(classes.select("fp"))
    if count > 1:
        links = similar_links(rows.select("fp", F.col("_fps").alias("fps"), F.col("_blocks" if block_shingle else "_fps").alias("blocks")), count, links, spread=spread)
    # only linked classes need a component's name; all others are their own
    linked = checkpointed(classes.join(connected_components(links).withColumnRenamed("node", "fp"), "fp"))
    names = checkpointed(linked.groupBy("component").agg(F.min("least").alias("name")))
    named = linked.join(names, "component").select("fp", "name", F.col("component").alias("_group"))
    name = F.when(F.col("_group").isNotNull(), F.col("name")).otherwise(F.col("least"))
    named = checkpointed(classes.join(named, "fp", "left").select("fp", name.alias("component"), F.coalesce("_group", "fp").alias("group")))
    return rows.join(named, "fp").select(*kept, "fp", "component", "group")


def drop_near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, count: int = 1, block_shingle: int | None = None, spread: float = SPREAD
) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: of the smallest id, then the smallest SHA-256 of the text, then the smallest JSON form of the row. Rows with a null id stay.

    Only ids and digests leave the scoring pass; the texts are joined with those that go.
    """
    found = checkpointed(_grouped(docs, id_col, text_col, shingle, count, block_shingle, spread, digest=True).where("id IS NOT NULL").groupBy("group", "id", "digest").agg(F.count("*").alias("n")))
    first = found.groupBy("group").agg(F.min(F.struct("id", "digest")).alias("first"))
    found = found.join(first, "group").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), (F.struct("id", "digest") == F.col("first")).alias("_stays"), "n")
    found = checkpointed(found.where("n > 1 OR NOT _stays"))
    on = (docs[id_col] == F.col("_id")) & (_digest(text_col) == F.col("_digest"))
    once = docs.join(found, on, "left_anti")
    repeats = checkpointed(found.where("_stays").select("_id", "_digest"))
    if repeats.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(repeats, on, "left_semi").withColumn("_digest", _digest(text_col))
    again = again.groupBy(id_col, "_digest").agg(F.min_by(row, F.to_json(row)).alias("_row"))
    return once.unionByName(again.select("_row.*"))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
