"""Running values over the earlier rows of a key: a segmented prefix scan.

A window sorts all rows of a key in one task. Here the rows are cut into ranges of
(key, order): cuts are quantiles of a small sample, so a key with a large share of
the rows has many of them, at ties too, and most keys have none. Every range of a
key is scanned by its own task, and what a range hands on to the later ones of its
key is one row of totals. Cuts change where a row is scanned and never a value.

Order is the given columns, nulls first and NaN last, then a hash of the whole
row: rows that differ have one order, wherever they come from, and rows that do
not differ may stand either way round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the sample for each cut, those of the smallest hashes.
SAMPLED = 64

PART, TIE = "_part", "_tie"
_CUTS = "_cuts"


@dataclass(frozen=True)
class Measure:
    """A running value of a column: max, count of true, first or last non-null."""

    kind: str
    value: Column


@dataclass(frozen=True)
class Cuts:
    """Where the rows of a key are cut.

    ``at`` has one row per cut key: its cuts in order, as structs of the order
    columns and the tie. All keys together have as many cuts as were asked for.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    row: tuple[str, ...]
    at: DataFrame

    def _with_cuts(self, rows: DataFrame) -> DataFrame:
        named = self.at.withColumnsRenamed({k: f"_of_{k}" for k in self.keys})
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        # As many rows at most as there are cuts, whatever the input.
        return rows.join(F.broadcast(named), same, "left").drop(*[f"_of_{k}" for k in self.keys])

    def assign(self, rows: DataFrame) -> DataFrame:
        """Add the tie of each row and its range among those of its key."""
        place = F.struct(*self.order, TIE)
        passed = F.filter(_CUTS, lambda cut: cut <= place)
        part = F.coalesce(F.size(passed), F.lit(0))
        return self._with_cuts(rows.withColumn(TIE, tie(self.row))).withColumn(PART, F.greatest(part, F.lit(0)))

    def replicate(self, lookup: DataFrame) -> DataFrame:
        """Give a lookup row to every range of its key."""
        last = F.greatest(F.coalesce(F.size(_CUTS), F.lit(0)), F.lit(0))
        every = F.explode(F.sequence(F.lit(0), last))
        return self._with_cuts(lookup).withColumn(PART, every).drop(_CUTS)


def tie(columns: Sequence[str]) -> Column:
    """What orders rows that are equal in the order columns."""
    return F.xxhash64(*columns)


def find_cuts(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: int | None = None
) -> Cuts:
    """Cuts of the rows, as many as the session has shuffle partitions unless given.

    The sample is a fixed number of rows a cut, whatever the size of the input;
    Spark keeps no more of any task.
    """
    cuts = cuts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = tuple(f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString())
    place = [*keys, *order, TIE]
    sample = rows.withColumn(TIE, tie(whole)).select(*place)
    sample = sample.orderBy(F.xxhash64(*place)).limit(cuts * SAMPLED)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*place))
    picked = sample.withColumn("_number", number).filter(F.col("_number") % SAMPLED == 0)
    at = picked.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*order, TIE))).alias(_CUTS)
    )
    return Cuts(tuple(keys), tuple(order), whole, at)


def running_before(
    rows: DataFrame, cuts: Cuts, measures: Mapping[str, Measure]
) -> DataFrame:
    """Add each measure taken over the rows of the key before the current one.

    The rows must have their range assigned.
    """
    order = [*cuts.order, TIE]
    before = (
        Window.partitionBy(*cuts.keys, PART)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = rows.select("*", *[_over(m, before).alias(n) for n, m in measures.items()])
    carried = _carry(rows.filter(F.col(_CUTS).isNotNull()), cuts, order, measures)
    same = F.col(PART) == F.col(f"_of_{PART}")
    for k in cuts.keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    # One row a range of a cut key: at most two a cut.
    joined = local.join(F.broadcast(carried), same, "left")
    result = {
        n: _combine(m.kind, F.col(f"_carry_{n}"), F.col(n)) for n, m in measures.items()
    }
    return joined.withColumns(result).select(*local.columns)


def _carry(
    rows: DataFrame, cuts: Cuts, order: Sequence[str], measures: Mapping[str, Measure]
) -> DataFrame:
    """The measures over all ranges of a key before the given one."""
    totals = rows.groupBy(*cuts.keys, PART).agg(
        *[_total(m, order).alias(f"_carry_{n}") for n, m in measures.items()]
    )
    before = (
        Window.partitionBy(*cuts.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *[F.col(k).alias(f"_of_{k}") for k in (*cuts.keys, PART)],
        *[
            _fold(m.kind, F.col(f"_carry_{n}")).over(before).alias(f"_carry_{n}")
            for n, m in measures.items()
        ],
    )


def _over(m: Measure, window) -> Column:
    if m.kind == "max":
        return F.max(m.value).over(window)
    if m.kind == "first":
        return F.first(m.value, ignorenulls=True).over(window)
    if m.kind == "last":
        return F.last(m.value, ignorenulls=True).over(window)
    if m.kind == "count":
        return F.count_if(m.value).over(window)
    raise ValueError(f"unknown running value {m.kind!r}")


def _total(m: Measure, order: Sequence[str]) -> Column:
    if m.kind == "max":
        return F.max(m.value)
    # min_by and max_by skip rows whose order is null, hence only the wanted ones.
    at = F.when(m.value.isNotNull(), F.struct(*order))
    if m.kind == "first":
        return F.min_by(m.value, at)
    if m.kind == "last":
        return F.max_by(m.value, at)
    return F.count_if(m.value)


def _fold(kind: str, column: Column) -> Column:
    if kind == "max":
        return F.max(column)
    if kind == "first":
        return F.first(column, ignorenulls=True)
    if kind == "last":
        return F.last(column, ignorenulls=True)
    return F.sum(column)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "count":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "first":
        return F.coalesce(carried, local)
    if kind == "last":
        return F.coalesce(local, carried)
    return F.when(carried.isNull() | (local > carried), local).otherwise(carried)
