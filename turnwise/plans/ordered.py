"""Ordered per-group computations that stay balanced when one group is huge.

A window puts a whole group into one task.  ``Ordered`` first counts the groups.  While every group
fits a task it is a plain window over the keys.  Otherwise the rows of the groups above the limit are
dealt by ranges of keys and order columns, about half the limit each, and stored with the number of
their range: the window runs per (group, range), and what precedes a range (row counts, sums, last
value) comes from one row per group and range.  The number of ranges follows the rows, so a task
never gets more of them as the data grow; the summaries are joined like any table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.session import cut_lineage

ROWS_PER_TASK = 1_000_000
ROWS_PER_TASK_CONF = "spark.turnwise.rowsPerTask"

_RANGE = "__range"


def rows_per_task(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_PER_TASK_CONF, str(ROWS_PER_TASK)))


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"{prefix}{k}"]) for k in keys], F.lit(True))


class Ordered:
    """Rows of ``df`` in the order of ``order`` (ascending, total) inside each group of ``keys``.

    ``keys`` may be empty, which means one global order.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: int | None = None,
                 probe: DataFrame | None = None, sizes: tuple[int, int] | None = None):
        """``probe`` holds the same groups and order columns and is cheaper to count than ``df``.

        ``sizes`` (all rows, rows of the largest group) spares the count when the caller knows them.
        """
        self.keys = list(keys)
        self.order = list(order)
        limit = rows or rows_per_task(df)
        counts = (df if probe is None else probe).groupBy(*self.keys).agg(F.count(F.lit(1)).alias("__n"))
        _, top = sizes or counts.agg(F.sum("__n"), F.max("__n")).first()
        self.split = (top or 0) > limit
        # The rows are read once per summary and once for the windows, so they are stored when split.
        self.df = _tag_ranges(df, counts.where(F.col("__n") > limit), self.keys, self.order, limit) if self.split else df

    # -- windows ---------------------------------------------------------------------------

    def _group(self) -> list[str]:
        return self.keys + ([_RANGE] if self.split else [])

    def _window(self):
        return Window.partitionBy(*[F.col(k) for k in self._group()]).orderBy(*self.order)

    def _hot(self) -> DataFrame:
        return self.df.where(F.col(_RANGE).isNotNull())

    def _join_summary(self, summary: DataFrame) -> DataFrame:
        """Join with the rows per group and range; groups that are not split have none."""
        renamed = summary.select(
            *[F.col(k).alias(f"__s_{k}") for k in self.keys + [_RANGE]],
            *[c for c in summary.columns if c not in self.keys + [_RANGE]],
        )
        on = _same(self.df, renamed, self.keys, "__s_") & (self.df[_RANGE] == renamed[f"__s_{_RANGE}"])
        return self.df.join(renamed, on, "left").drop(*[f"__s_{k}" for k in self.keys + [_RANGE]])

    def running(self, **sums: Column) -> "Ordered":
        """Inclusive running sums, NULL until a value was seen; an expression ``F.lit(1)`` gives the row number."""
        win = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        if not self.split:
            self.df = self.df.withColumns({name: F.sum(expr).over(win) for name, expr in sums.items()})
            return self
        before = Window.partitionBy(*[F.col(k) for k in self.keys]).orderBy(_RANGE).rowsBetween(
            Window.unboundedPreceding, -1)
        totals = self._hot().groupBy(*self.keys, _RANGE).agg(
            *[F.sum(expr).alias(f"__t_{name}") for name, expr in sums.items()])
        totals = totals.select(*self.keys, _RANGE, *[
            F.sum(f"__t_{name}").over(before).alias(f"__b_{name}") for name in sums])
        local = {name: F.sum(expr).over(win) for name, expr in sums.items()}
        self.df = self._join_summary(totals)
        self.df = self.df.withColumns({
            name: F.coalesce(local[name] + F.col(f"__b_{name}"), local[name], F.col(f"__b_{name}")) for name in sums
        }).drop(*[f"__b_{name}" for name in sums])
        return self

    def previous(self, **values: str) -> "Ordered":
        """Value of a column in the preceding row of the group, NULL in the first row."""
        win = self._window()
        if not self.split:
            self.df = self.df.withColumns({name: F.lag(col).over(win) for name, col in values.items()})
            return self
        key = F.struct(*self.order)
        lasts = self._hot().groupBy(*self.keys, _RANGE).agg(
            *[F.max_by(F.struct(F.col(col).alias("v")), key).alias(f"__l_{name}") for name, col in values.items()])
        over = Window.partitionBy(*[F.col(k) for k in self.keys]).orderBy(_RANGE)
        lasts = lasts.select(*self.keys, _RANGE, *[
            F.lag(f"__l_{name}").over(over).alias(f"__p_{name}") for name in values])
        self.df = self._join_summary(lasts).withColumn("__rn", F.row_number().over(win))
        self.df = self.df.withColumns({
            name: F.when(F.col("__rn") == 1, F.col(f"__p_{name}")["v"]).otherwise(F.lag(col).over(win))
            for name, col in values.items()
        }).drop("__rn", *[f"__p_{name}" for name in values])
        return self

    def row_number(self, name: str = "rn") -> "Ordered":
        return self.running(**{name: F.lit(1).cast("long")})

    def derive(self, **exprs: Column) -> "Ordered":
        self.df = self.df.withColumns(exprs)
        return self

    def result(self) -> DataFrame:
        return self.df.drop(_RANGE)


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "rn",
                probe: DataFrame | None = None) -> DataFrame:
    """Dense numbers 1..n inside each group."""
    return Ordered(df, keys, order, probe=probe).row_number(name).result()


def _tag_ranges(df: DataFrame, large: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """All rows, stored, with the number of their range; NULL for groups that are not ``large`` (keys, ``__n``)."""
    rows = large.agg(F.sum("__n")).first()[0]
    ranges = -(-2 * rows // limit)
    none = F.lit(None).cast("int").alias(_RANGE)

    def dealt(part: DataFrame) -> DataFrame:
        return part.repartitionByRange(ranges, *keys, *order).select("*", F.spark_partition_id().alias(_RANGE))

    if not keys:
        return cut_lineage(dealt(df))
    named = large.select(*[F.col(k).alias(f"__k_{k}") for k in keys])
    same = _same(df, named, keys, "__k_")
    return cut_lineage(df.join(named, same, "left_anti").select("*", none).unionByName(dealt(df.join(named, same, "left_semi"))))
