"""Ordered work on keys of any size: rows dealt out by range, and scans in two levels.

A window over a key that holds a third of all rows is one task.  Here rows are sorted over all
tasks by (key, order); what a scan needs of the parts before (or after) a part is one row for
each part that a key reaches into, and is joined to the rows of that part alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from texloom.plans.tables import cut

PART, PLACE = "_part", "_place"


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in the shared folder, sorted by keys and order over all its parts, with the part and the place in it.

    Null keys and orders stand first; rows that tie in all of them stay in one part.
    """
    ranked = df.repartitionByRange(partitions(df), *keys, *order).sortWithinPartitions(*keys, *order)
    place = F.monotonically_increasing_id()
    return cut(ranked.select("*", F.shiftright(place, 33).cast("int").alias(PART), place.bitwiseAND(F.lit((1 << 33) - 1)).alias(PLACE)), "dealt")


def _same(keys: list[str]) -> Column:
    test = F.col(f"l.{PART}") == F.col(f"r.{PART}")
    for k in keys:
        test = test & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return test


def _with_carry(rows: DataFrame, keys: list[str], carry: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the columns of carry, which has one row for each key and part."""
    joined = rows.alias("l").join(carry.alias("r"), _same(keys), "left")
    return joined.select("l.*", *[f"r.{c}" for c in columns])


def running(rows: DataFrame, keys: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """Dealt rows with the sums (column -> new name), or bitwise differences, over the rows of their key before them; 0 for the first."""
    plus, xor = (lambda a, b: a + b), (lambda a, b: a.bitwiseXOR(b))
    wanted = [(c, n, F.sum, plus) for c, n in (sums or {}).items()] + [(c, n, F.bit_xor, xor) for c, n in (xors or {}).items()]
    inside = Window.partitionBy(*keys, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(f(c).over(inside), F.lit(0)).alias(f"_in_{n}") for c, n, f, _ in wanted])
    whole = rows.groupBy(*keys, PART).agg(*[f(c).alias(f"_of_{n}") for c, n, f, _ in wanted])
    carry = whole.select(*keys, PART, *[F.coalesce(f(f"_of_{n}").over(above), F.lit(0)).alias(f"_up_{n}") for _, n, f, _ in wanted])
    carried = _with_carry(local, keys, carry, [f"_up_{n}" for _, n, _, _ in wanted])
    # no row of a part before the first has anything above it
    return carried.select(*rows.columns, *[op(F.col(f"_in_{n}"), F.coalesce(f"_up_{n}", F.lit(0))).alias(n) for _, n, _, op in wanted])


def neighbour(rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Dealt rows with the values (column -> new name) of the row of their key just before them, null for the first."""
    inside = Window.partitionBy(*keys, PART).orderBy(PLACE)
    names = list(values)
    here = F.struct(*names)
    local = rows.withColumn("_was", F.lag(here).over(inside))
    last = rows.groupBy(*keys, PART).agg(F.max_by(here, PLACE).alias("_last"))
    carried = _with_carry(local, keys, last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART))), ["_before"])
    got = F.coalesce("_was", "_before")
    return carried.select(*[c for c in rows.columns], *[got[c].alias(n) for c, n in values.items()])


def surrounding(rows: DataFrame, keys: list[str], value: str, low: str, high: str) -> DataFrame:
    """Dealt rows with the last value that is not null at or before them, and the first one after them, in their key."""
    order = Window.partitionBy(*keys, PART).orderBy(PLACE)
    local = rows.withColumn("_low", F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.withColumn("_high", F.first(value, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    some = F.col(value).isNotNull()
    ends = rows.groupBy(*keys, PART).agg(F.max_by(value, F.when(some, F.col(PLACE))).alias("_last"), F.min_by(value, F.when(some, F.col(PLACE))).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(PART)
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    carried = _with_carry(local, keys, ends, ["_before", "_after"])
    return carried.select(*[c for c in rows.columns], F.coalesce("_low", "_before").alias(low), F.coalesce("_high", "_after").alias(high))
