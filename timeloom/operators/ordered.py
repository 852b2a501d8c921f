"""Ranks, running sums and previous rows over keys of any size.

Rows are dealt to ranges of (key, order), so a key with a third of all rows spreads over many tasks. Inside a range windows do the work; what the rows of
one key in earlier ranges add is carried over in a table that has at most one row for each range, and so can be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stage

#: A row's place: its range, and its number in it.
PLACE = ("_p", "_i")
_BITS = 33  # of monotonically_increasing_id for the number in a partition


#: A key with more rows is a hot one: its rows are dealt to ranges, where those of other keys are cheaper to keep together.
HOT_ROWS = 1_000_000


def has_hot_key(df: DataFrame, key: str) -> bool:
    """Whether a key has so many rows that one task shouldn't go through them."""
    return not df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).isEmpty()


def ranged(df: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """df in ranges of (key, order), with PLACE. The order has to part all rows that must not change places: equal rows stay in one range."""
    by = [F.col(key), *(F.col(c) if isinstance(c, str) else c for c in order)]
    rows = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row_", F.monotonically_increasing_id()))
    return rows.select("*", F.shiftright("_row_", _BITS).alias("_p"), F.col("_row_").bitwiseAND((1 << _BITS) - 1).alias("_i")).drop("_row_")


def unranged(df: DataFrame) -> DataFrame:
    return df.drop(*PLACE)


def carried(rows: DataFrame, key: str, parts: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """rows with the columns `carry`, of what parts gives for the rows of the row's key in earlier ranges; null without any. carry's
    columns are over _w, the windows of which see the earlier ranges' parts of one key."""
    each = rows.groupBy("_p", key).agg(F.min("_i").alias("_first"), *[c.alias(n) for n, c in parts.items()])
    # only the first key of a range can have rows in earlier ones
    over = each.select("_p", F.col(key).alias("_key"), "_first", F.lit(True).alias("_carried"), *[c.alias(n) for n, c in carry.items()]).where("_first = 0").drop("_first")
    over = F.broadcast(over.withColumnRenamed("_p", "_q"))
    return rows.join(over, (F.col("_p") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_key")), "left").drop("_q", "_key", "_carried")


def earlier(key: str):
    return Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, key: str, sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """ranged rows with new columns: the sums, or the least values, of all earlier rows of the row's key; 0 or null without any."""
    before = Window.partitionBy("_p", key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    todo = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.min) for n, c in (least or {}).items()]
    parts = {f"_t{i}": f(c) for i, (_, c, f) in enumerate(todo)}
    carry = {f"_c{i}": f(f"_t{i}").over(earlier(key)) for i, (_, _, f) in enumerate(todo)}
    rows = carried(rows, key, parts, carry)
    for i, (name, c, f) in enumerate(todo):
        here, then = f(c).over(before), F.col(f"_c{i}")
        rows = rows.withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce(then, F.lit(0)) if f is F.sum else F.least(here, then))
    return rows.drop(*carry)


def previous(rows: DataFrame, key: str, **columns: Column) -> DataFrame:
    """ranged rows with new columns: the values of the row before in the row's key, null for its first one."""
    names = list(columns)
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    rows = carried(rows, key, {"_t": F.max_by(value, "_i")}, {"_c": F.last("_t").over(earlier(key))})
    here = F.lag(value).over(Window.partitionBy("_p", key).orderBy("_i"))
    rows = rows.withColumn("_v", F.coalesce(here, F.col("_c")))
    return rows.select("*", *[F.col(f"_v.{n}").alias(n) for n in names]).drop("_v", "_c")


def numbered(df: DataFrame, key: str, order: list[Column | str], name: str) -> DataFrame:
    """df with each row's number in its key from 1 on, in this order: in ranges where a key is hot, else by a window of each key."""
    if not has_hot_key(df, key):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    rows = running(ranged(df, key, order), key, sums={"_before": F.lit(1)})
    return unranged(rows).withColumn(name, (F.col("_before") + 1).cast("int")).drop("_before")
