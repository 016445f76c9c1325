"""Ordered computations over keys of any size: ranks, previous values and guarded states.

A window over a key is one task, however many rows the key has. Keys beyond a limit are therefore cut into ranges that follow
each other; each range is computed by itself, and one row a range carries what the next ones need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from skein.functions.shared import broadcast_if_small, checkpointed

#: Rows of a key that one task may order.
LIMIT = 1_000_000


def split_hot(df: DataFrame, by: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most ``limit`` rows, rows of the other keys or None); a null is a key, too."""
    hot = checkpointed(df.groupBy(F.col(by).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select("_key"))
    if hot.isEmpty():
        return df, None
    same, hot = F.col(by).eqNullSafe(F.col("_key")), broadcast_if_small(hot)
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def in_ranges(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with _range: rows sorted by key and ``order``, dealt evenly over as many ranges as there are shuffle partitions.

    It is checkpointed, so that a row's range stays what it is when a task is run again; the rows of a partition are in order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    return checkpointed(dealt.withColumn("_range", F.spark_partition_id()))


def ranked(df: DataFrame, by: str, order: Sequence[Column], name: str = "rank", limit: int = LIMIT) -> DataFrame:
    """``df`` with the place of each row within its key under ``order``, which must decide every tie. A key without rows has none; null is a key."""
    rest, hot = split_hot(df, by, limit)
    out = rest.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    if hot is None:
        return out
    rows = in_ranges(hot, by, order)
    sizes = rows.groupBy(F.col(by).alias("_key"), "_range").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_size")).withColumnRenamed("_range", "_r")
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)))
    met = placed.join(before, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return out.unionByName(met.select(*df.columns, (F.col("_before") + F.col("_place")).alias(name)))


def with_previous(df: DataFrame, by: str, order: Sequence[Column], value: str, name: str, limit: int = LIMIT) -> DataFrame:
    """``df`` with the ``value`` of the row before within its key under ``order``, which must decide every tie; null for a first row."""
    rest, hot = split_hot(df, by, limit)
    out = rest.withColumn(name, F.lag(value).over(Window.partitionBy(by).orderBy(*order)))
    if hot is None:
        return out
    rows = in_ranges(hot, by, order)
    inside = Window.partitionBy(by, "_range").orderBy(*order)
    placed = rows.withColumns({"_place": F.row_number().over(inside), "_lag": F.lag(value).over(inside), "_next": F.lead(F.lit(1)).over(inside)})
    lasts = placed.where("_next IS NULL").select(F.col(by).alias("_key"), F.col("_range").alias("_r"), F.col(value).alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy("_key").orderBy("_r"))).drop("_last")
    met = placed.join(carried, F.col(by).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_r")))
    return out.unionByName(met.select(*df.columns, F.when(F.col("_place") == 1, F.col("_carried")).otherwise(F.col("_lag")).alias(name)))


class Guard:
    """What an event does to a state: states and targets by number, 0 before any event; an event that is not allowed leaves the state as it is."""

    def __init__(self, transitions: Sequence[tuple[str, str]], initial: Sequence[str]):
        self.names = [None, *sorted({x for pair in transitions for x in pair} | set(initial))]
        self.code = {name: i for i, name in enumerate(self.names) if i}
        allowed = {(self.code[a], self.code[b]) for a, b in transitions} | {(0, self.code[a]) for a in initial}
        n = len(self.names)
        #: after[target][state]; the last row is that of targets that no transition names.
        self.after = [[t if (s, t) in allowed else s for s in range(n)] for t in range(n)] + [list(range(n))]
        self.allowed = allowed

    def target(self, name: str | None) -> int:
        return self.code.get(name, len(self.names))


def guarded(events: DataFrame, by: str, order: Sequence[Column], status: str, transitions: Sequence[tuple[str, str]], initial: Sequence[str]) -> DataFrame:
    """``events`` with from_status (the state before), accepted, and state (after); a refused event leaves the state as it was.

    A key's first accepted event asks for one of ``initial``, each later one for a status that ``transitions`` allow. ``order`` must decide every tie.
    A null or unknown status is refused, a null key is a key of its own, an empty table stays empty.

    Each range of the ordered events maps every state in which it may begin to the one in which it ends; maps of a range are composed event by event, those of
    the ranges in turn. A map has as many numbers as there are states, and the driver gets one a range. The second pass then knows the state each range begins with.
    """
    guard = Guard(transitions, initial)
    rows = in_ranges(events, by, order)
    kept = [c for c in events.columns if c not in ("from_status", "accepted", "state")]
    key = rows.schema[by].dataType
    summary = StructType([StructField("first", key), StructField("last", key)]).simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = kind = None
        place, alone, ends, state = None, True, list(range(len(guard.names))), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, targets = batch.column(by).to_pylist(), map(guard.target, batch.column(status).to_pylist())
            if place is None:
                place, first, last, kind = batch.column("_range")[0].as_py(), keys[0], keys[0], batch.column(by).type
            for k, t in zip(keys, targets):
                if k != last:
                    last, alone, state = k, False, 0
                after = guard.after[t]
                if alone:
                    ends = [after[s] for s in ends]
                else:
                    state = after[state]
        if place is not None:
            ids = pa.StructArray.from_arrays([pa.array([first], kind), pa.array([last], kind)], ["first", "last"])
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), ids, pa.array([alone]), pa.array([ends], pa.list_(pa.int32())), pa.array([state], pa.int32())], ["place", "ids", "alone", "ends", "state"])

    begins: dict[int, int] = {}
    last, state = object(), 0
    slim = rows.select(by, status, "_range")
    for r in sorted(slim.mapInArrow(maps, f"place int, ids {summary}, alone boolean, ends array<int>, state int").collect(), key=lambda r: r["place"]):  # one row a range
        begins[r["place"]] = begin = state if r["ids"]["first"] == last else 0
        last, state = r["ids"]["last"], r["ends"][begin] if r["alone"] else r["state"]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, started = 0, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, targets = batch.column(by).to_pylist(), map(guard.target, batch.column(status).to_pylist())
            if not started:
                state, last, started = begins[batch.column("_range")[0].as_py()], keys[0], True
            before, fits, after = [], [], []
            for k, t in zip(keys, targets):
                if k != last:
                    last, state = k, 0
                before.append(guard.names[state])
                fits.append((state, t) in guard.allowed)
                state = guard.after[t][state]
                after.append(guard.names[state])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(before, pa.string()), pa.array(fits, pa.bool_()), pa.array(after, pa.string())], [*kept, "from_status", "accepted", "state"])

    fields = [rows.schema[c] for c in kept]
    return rows.mapInArrow(states, StructType([*fields, StructField("from_status", StringType()), StructField("accepted", BooleanType()), StructField("state", StringType())]))

