"""Fuzzy dictionary matches over token windows.

Windows that equal a name protect their tokens. Other windows get their most similar
name; per text the best candidates that don't overlap are selected in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import constants as K
from skein.functions.shared import broadcast_if_small, checkpointed
from skein.functions.text import tokens


def token_windows(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...] = K.WINDOWS) -> DataFrame:
    """(key, start, stop, span): all runs of ``sizes`` tokens without an empty one, the span without spaces."""
    toks = F.col("_tokens")
    none = F.array().cast("array<struct<start:int,stop:int,span:string,full:boolean>>")

    def windows(n: int) -> Column:
        def one(i):
            run = F.slice(toks, i + 1, F.lit(n))
            return F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(run, "").alias("span"), F.forall(run, lambda t: t != "").alias("full"))

        return F.when(F.size(toks) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(toks) - n, F.lit(0))), one)).otherwise(none)

    # the text is split in a step of its own, not once a window
    split = texts.select(key, tokens(F.col(text)).alias("_tokens"))
    return split.select(key, F.explode(F.filter(F.concat(*map(windows, sizes)), lambda w: w["full"])).alias("_w")).select(key, "_w.start", "_w.stop", "_w.span")


def segments(names: DataFrame, min_similarity: float) -> DataFrame:
    """(name, ord, bare, size, reach, place, at, width, piece): each name cut into one piece more than the edits it may have.

    ``bare`` is the name without spaces. Pieces are as long as each other, the last ones one character longer where the length asks for it; of any text within ``reach`` edits one
    piece at least is a part. A name of no characters has none.
    """
    bare = F.replace("name", F.lit(" "), F.lit(""))
    df = names.select("name", "ord", bare.alias("bare"), F.length(bare).alias("size")).where("size > 0")
    df = df.withColumn("reach", F.least(F.floor(F.col("size") * (1 - min_similarity) + 1e-9).cast("int"), F.col("size") - 1)).where("reach >= 0")
    df = df.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("reach"))))
    df = df.withColumns({"_base": F.expr("cast(size div (reach + 1) as int)"), "_short": F.expr("reach + 1 - size % (reach + 1)")})
    at, width = F.col("place") * F.col("_base") + F.greatest(F.lit(0), F.col("place") - F.col("_short")), F.col("_base") + F.when(F.col("place") >= F.col("_short"), 1).otherwise(0)
    df = df.withColumns({"at": at, "width": width}).drop("_base", "_short")
    return df.withColumn("piece", F.substring("bare", F.col("at") + 1, F.col("width")))


def near_pairs(spans: DataFrame, names: DataFrame, min_similarity: float) -> DataFrame:
    """(span, name, ord, bare, size, reach): pairs that share a piece where it can stand, among them each pair within the name's reach; a pair may come more than once.

    Where a text lies within k edits of a name, some piece i has at most i of them before it and k - i after it, and so has moved by no more: only these parts of a text are looked up, by an equi-join.
    """
    pieces = checkpointed(segments(names, min_similarity))
    shapes = pieces.select("size", "reach", "place", "at", "width").distinct()  # as many as names have lengths, times their pieces
    shapes = shapes.withColumn("_len", F.explode(F.sequence(F.greatest(F.lit(1), F.col("size") - F.col("reach")), F.col("size") + F.col("reach"))))
    low = F.greatest(F.lit(0), F.col("at") - F.col("place"), F.expr("at + _len - size - reach + place"))
    high = F.least(F.col("_len") - F.col("width"), F.col("at") + F.col("place"), F.expr("at + _len - size + reach - place"))
    shapes = shapes.withColumns({"_low": low, "_high": high}).where("_low <= _high").select("_len", "size", "place", "width", F.explode(F.sequence("_low", "_high")).alias("_at"))
    parts = spans.withColumn("_len", F.length("span")).join(broadcast_if_small(checkpointed(shapes)), "_len").select("span", "size", "place", F.substring("span", F.col("_at") + 1, F.col("width")).alias("piece"))
    return parts.join(broadcast_if_small(pieces.drop("at", "width")), ["size", "place", "piece"]).select("span", "name", "ord", "bare", "size", "reach")


def fuzzy_candidates(texts: DataFrame, dictionary: DataFrame, *, key: str = "doc_id", text: str = "text", min_similarity: float = K.MIN_SIMILARITY, sizes: tuple[int, ...] = K.WINDOWS) -> DataFrame:
    """(key, start, stop, span, name, similarity): each window's best name, not overlapping an exact match. ``dictionary`` has name and ord, of any ordered type, which breaks ties.

    Spans are compared once each, and only with names that share a piece with them (see near_pairs). Null texts have no windows, null names match nothing.
    """
    rows = token_windows(texts, key, text, sizes)
    names = dictionary.select("name", "ord")
    exact = rows.join(names.select(F.col("name").alias("span")).distinct(), "span", "left_semi").select(key, F.explode(F.sequence("start", F.col("stop") - 1)).alias("_t")).distinct()
    # few bytes but much work a span: a given number of partitions is not merged for being small
    spans = rows.select("span").distinct().repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "span")
    # the bounded edit distance stops early and is -1 beyond the bound
    met = near_pairs(spans, names, min_similarity).withColumn("_d", F.call_function("levenshtein", "bare", "span", "reach")).where("_d >= 0")
    scored = met.withColumn("_sim", 1 - F.col("_d") / F.col("size")).where((F.col("_sim") >= min_similarity) & (F.col("_sim") > 0))
    best = checkpointed(scored.groupBy("span").agg(F.min(F.struct((-F.col("_sim")).alias("_n"), "ord", "name")).alias("_b")).select("span", F.col("_b.name").alias("name"), (-F.col("_b._n")).alias("similarity")))
    found = rows.join(best, "span")
    touched = found.select(key, "start", "stop", F.explode(F.sequence("start", F.col("stop") - 1)).alias("_t")).join(exact, [key, "_t"], "left_semi").select(key, "start", "stop").distinct()
    found = found.join(touched, [key, "start", "stop"], "left_anti")
    return found.select(key, "start", "stop", "span", "name", F.bround("similarity", 3).alias("similarity"))


def select_candidates(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The candidates that remain when, by falling similarity, then window size and place, each one that overlaps an earlier choice is left out.

    In each round a candidate that comes before all it overlaps with is chosen, and those that overlap a chosen one go; what is left meets again in the next round.
    A token has few candidates, so no group is large. Candidates have a place (key, start, stop) of their own; a null key has none to overlap with and is left out.
    """
    place = [key, "start", "stop"]
    rank = F.struct((-F.col("similarity")).alias("a"), (F.col("stop") - F.col("start")).alias("b"), F.col("start").alias("c"))
    left = checkpointed(found.where(F.col(key).isNotNull()).withColumn("_rank", rank))
    chosen = None
    while not left.isEmpty():
        covered = left.select(*place, "_rank", F.explode(F.sequence("start", F.col("stop") - 1)).alias("_t"))
        first = covered.withColumn("_first", F.min("_rank").over(Window.partitionBy(key, "_t")))
        wins = checkpointed(first.groupBy(*place).agg(F.bool_and(F.col("_rank") == F.col("_first")).alias("_wins")).where("_wins").drop("_wins"))
        taken = wins.select(key, F.explode(F.sequence("start", F.col("stop") - 1)).alias("_t"))
        gone = covered.join(taken, [key, "_t"], "left_semi").select(*place).distinct()
        picked = left.join(wins, place, "left_semi").select(*found.columns)
        left = checkpointed(left.join(gone, place, "left_anti"))
        chosen = picked if chosen is None else chosen.unionByName(picked)
    return found.limit(0) if chosen is None else chosen
