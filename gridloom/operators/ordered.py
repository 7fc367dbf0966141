"""Operators that need an order over whole tables: positions, running totals, as-of lookups and ranks.

None of them sorts a table into one partition. Rows are dealt into ranges of the ordering column, whose bounds are
literals found beforehand; within a range a window does the work, and what earlier ranges contribute comes from one row
for each range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that an ordered operator deals its rows into at most; one row of each is summed in one place.
RANGES = 4096
#: Values of an exact sum that come to the driver at once.
FOLDED = 1 << 16
#: Rows that bounds of values without percentiles are taken from.
SAMPLE = 1 << 14
#: Rows of a block of neighbouring rows.
BLOCK = 1 << 13


def ranges_of(df: DataFrame, by: Column) -> list:
    """Ascending bounds that cut the values of ``by``, of any type that has an order, into ranges of about equal size."""
    parts = min(RANGES, max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if parts == 1:
        return []
    own = df.select(by.alias("b"))
    if not isinstance(own.schema[0].dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return sampled_bounds(own, parts)
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = own.agg(F.percentile_approx("b", shares, 10_000).alias("b")).first()["b"]
    return sorted(set(found or []))


def sampled_bounds(own: DataFrame, parts: int) -> list:
    """Bounds of the only column's values, from the SAMPLE rows of least hash. The hash is of the value and of the row's
    place, so that a value that many rows hold counts as often."""
    own = own.where(F.col("b").isNotNull()).select("b", F.xxhash64("b", F.monotonically_increasing_id()).alias("h"))
    values = own.orderBy("h").limit(SAMPLE).select("b").orderBy("b").collect()  # SAMPLE values at most
    cuts = [values[i * len(values) // parts]["b"] for i in range(1, parts)] if values else []
    return [x for i, x in enumerate(cuts) if i == 0 or x != cuts[i - 1]]


def range_number(by: Column, bounds: list) -> Column:
    """The range of a value: how many bounds are not above it, found by halving and, of many bounds, among the 64 that
    halving leaves."""

    def literal(b: object) -> Column:
        return F.struct(*(F.lit(x).alias(k) for k, x in b.asDict().items())) if isinstance(b, Row) else F.lit(b)

    def within(lo: int, hi: int, of: list) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(by >= literal(of[mid]), within(mid + 1, hi, of)).otherwise(within(lo, mid, of))

    if len(bounds) <= 64:
        return within(0, len(bounds), bounds)
    runs = [bounds[i : i + 64] for i in range(0, len(bounds), 64)]
    coarse = within(0, len(runs) - 1, [r[0] for r in runs[1:]])
    table = F.array(*(F.array(*map(literal, r)) for r in runs))
    return coarse * 64 + F.size(F.filter(F.get(table, coarse), lambda b: b <= by))


#: How an aggregate goes on from what came before: the fold, and how two parts are joined.
FOLDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "product": (F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * F.coalesce(b, F.lit(1.0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, by: Column, ties: list[Column], value: Column, kind: str, name: str) -> DataFrame:
    """``df`` with a fold (of FOLDS) of ``value`` over all rows up to each row in the order of ``by`` and ``ties``. Rows
    whose ``by`` is null come first."""
    bounds = ranges_of(df, by)
    fold, join = FOLDS[kind]
    dealt = df.withColumn("_range", F.coalesce(range_number(by, bounds), F.lit(0)))
    own = Window.partitionBy("_range").orderBy(by.asc_nulls_first(), *ties).rowsBetween(Window.unboundedPreceding, 0)
    totals = dealt.groupBy("_range").agg(fold(value).alias("_total"))  # one row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", fold("_total").over(before).alias("_carried"))
    out = dealt.withColumn("_own", fold(value).over(own)).join(F.broadcast(carried), "_range")  # RANGES rows at most
    return out.withColumn(name, join(F.col("_own"), F.col("_carried"))).drop("_range", "_own", "_carried")


def asof(lanes: DataFrame, asks: DataFrame, keys: list[str], at: str, values: dict[str, str], strict: bool = False) -> DataFrame:
    """For each distinct ask (``keys`` and ``at``) the folds of the lanes' ``values`` (column -> kind) over the lanes of equal
    keys whose ``at`` isn't above the ask's, or with strict is below it. Null keys are equal to each other. Both sides are
    dealt into ranges of ``at``; what a key's earlier ranges add up to is one row for each key and range."""
    bounds = ranges_of(lanes, F.col(at))
    side = (1, 0) if strict else (0, 1)
    none = [F.lit(None).cast(dict(lanes.dtypes)[v]).alias(v) for v in values]
    both = lanes.where(F.col(at).isNotNull()).select(*keys, at, *values, F.lit(side[0]).alias("_side"))
    both = both.unionByName(asks.where(F.col(at).isNotNull()).select(*keys, at).distinct().select(*keys, at, *none, F.lit(side[1]).alias("_side")))
    both = both.withColumn("_range", range_number(F.col(at), bounds))
    within = Window.partitionBy("_range", *keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    totals = both.groupBy("_range", *keys).agg(*(FOLDS[k][0](v).alias(f"{v}_t") for v, k in values.items()))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"{k}_k") for k in keys), *(FOLDS[k][0](f"{v}_t").over(before).alias(f"{v}_c") for v, k in values.items()))
    out = both.withColumns({f"{v}_o": FOLDS[k][0](v).over(within) for v, k in values.items()}).where(F.col("_side") == side[1])
    on = F.col("_range") == F.col("_r")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_k"))
    return out.join(carried, on, "left").select(*keys, at, *(FOLDS[k][1](F.col(f"{v}_o"), F.col(f"{v}_c")).alias(v) for v, k in values.items()))


def windows(rows: DataFrame, hosts: DataFrame, first: int, last: int, payload: str, name: str) -> DataFrame:
    """_row and ``name`` for each of the hosts' rows: the payloads of the rows from ``first`` to ``last`` below it, in order.
    Rows are dealt into blocks; those that a neighbouring block sees too are sent there as well."""
    size = max(BLOCK, last - first + 1)
    block = lambda c: F.floor(c / size).cast("long")
    seen = rows.select(F.explode(F.sequence(block(F.col("_row") - last), block(F.col("_row") - first))).alias("_block"), "_row", F.col(payload).alias("_p"), F.lit(False).alias("_ask"))
    asks = hosts.select(block(F.col("_row")).alias("_block"), "_row", F.lit(None).cast(rows.schema[payload].dataType).alias("_p"), F.lit(True).alias("_ask"))
    near = Window.partitionBy("_block").orderBy("_row").rangeBetween(first, last)
    return seen.unionByName(asks).withColumn(name, F.collect_list("_p").over(near)).where("_ask").select("_row", name)


def with_positions(df: DataFrame, key: list[str], name: str = "_row") -> DataFrame:
    """``df`` with each row's place in the order of ``key``, from 1. The first two keys deal the ranges, so a first key that
    very many rows share is no range of its own."""
    by = F.col(key[0]) if len(key) == 1 else F.struct(*key[:2])
    out = running(df, by, [F.col(k).asc_nulls_first() for k in key[2:]], F.lit(1), "sum", name)
    return out.withColumn(name, F.col(name).cast("long"))


def ranked(df: DataFrame, value: str, name: str, ascending: bool = False) -> DataFrame:
    """RANK: 1 + how many values are better. Values are counted before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    by = F.col(value) if ascending else -F.col(value)
    counts = running(counts.withColumn("_by", by), F.col("_by"), [], F.col("_n"), "sum", "_to_here")
    places = counts.select(F.col(value).alias("_v"), (F.col("_to_here") - F.col("_n") + 1).cast("double").alias(name))
    return df.join(places, F.col(value) == F.col("_v"), "left").drop("_v")


def last_not_above(keys: DataFrame, key: str, lanes: DataFrame, value: str, place: str, name: str) -> DataFrame:
    """``keys`` with the greatest ``place`` among the lanes whose value isn't above the key: what a scan that keeps the last
    fit finds, sorted or not. Lanes and keys are ordered together and a running maximum is carried along."""
    lane = lanes.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.max(place).alias("_p"))
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_v")).distinct()
    both = lane.select("_v", "_p", F.lit(0).alias("_side")).unionByName(asked.select("_v", F.lit(None).cast("long").alias("_p"), F.lit(1).alias("_side")))
    carried = running(both, F.col("_v"), [F.col("_side")], F.col("_p"), "max", name)
    found = carried.where("_side = 1").select("_v", name)
    return keys.join(found, F.col(key) == F.col("_v"), "left").drop("_v")


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, column v: the middle value, or the mean of the two in the middle. Values are counted before they are ordered,
    and no task holds more than a range of them."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, F.col("_v"), [], F.col("_n"), "sum", "_to")
    total = counts.agg(F.sum("_n").alias("_all"))
    at = lambda place: F.max(F.when((F.col("_to") - F.col("_n") < place) & (place <= F.col("_to")), F.col("_v")))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    return placed.crossJoin(total).agg(((at(low) + at(high)) / 2).alias("v"))  # one row


def numbered(df: DataFrame, by: list[str], value: str, name: str, size: str | None = None) -> DataFrame:
    """``df`` with each row's place among its group's values in order, from 0, and, if asked for, the group's size. A group's
    values are dealt into ranges; rows move once, as what is counted and what is numbered share an exchange."""
    bounds = ranges_of(df, F.col(value))
    dealt = df.withColumn("_range", F.coalesce(range_number(F.col(value), bounds), F.lit(0))).repartition("_range", *by)
    totals = dealt.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = totals.select("_range", *by, before.alias("_before"), F.sum("_n").over(whole).alias("_size"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(F.col(value).asc_nulls_first()))
    out = dealt.withColumn("_own", own).join(carried, ["_range", *by]).withColumn(name, F.col("_own") + F.col("_before") - 1)
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_range", "_own", "_before", "_size")


def kth(df: DataFrame, value: str, k: int, largest: bool) -> DataFrame:
    """One row, column v: the k-th largest or smallest value, null if there are fewer."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    top = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).orderBy(order).limit(max(k, 0))
    edge = F.min("v") if largest else F.max("v")
    return top.agg(F.when(F.count("*") == k, edge).alias("v") if k >= 1 else F.lit(None).cast("double").alias("v"))


def ordered_sum(df: DataFrame, key: list[str], value: str, most: int | None = None) -> DataFrame:
    """One row, column v: the values added one by one in the order of ``key``, bit for bit as a loop adds them; of equal
    keys the smaller value comes first. Ranges of the key are sorted side by side, and the running double passes through
    them in order, one stretch of FOLDED values in memory at a time. More than ``most`` rows, if given, are an error."""
    if most is not None and (n := df.count()) > most:
        raise ValueError(f"{n} rows are more than was allowed ({most}); use sum")
    spark = df.sparkSession
    held = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v"))
    held = held.orderBy(*(F.col(f"_k{i}").asc_nulls_first() for i in range(len(key))), F.col("_v"))

    def step(batches):
        for batch in batches:
            v = batch.column("_v").to_numpy(zero_copy_only=False)
            for at in range(0, len(v), FOLDED):
                yield pa.RecordBatch.from_arrays([pa.array([v[at : at + FOLDED].astype("<f8").tobytes()], pa.binary())], ["values"])

    total = 0.0
    for row in held.select("_v").mapInArrow(step, "values binary").toLocalIterator():
        total = float(np.add.accumulate(np.concatenate([[total], np.frombuffer(row["values"], "<f8")]))[-1])
    return spark.range(1).select(F.lit(total).cast("double").alias("v"))
