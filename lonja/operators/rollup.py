"""Aggregates that are kept up to date from changed rows alone.

A changed row enters with its old image (minus) and its new one (plus); the signed sums of a cell are added to what
the cell holds.  Sums and counts only: they can be undone, a maximum cannot.  What is a maximum over rows, such as the day
of the last sale, becomes a maximum over cells that still hold something.  Each cell counts its rows, and
goes with the last of them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.operators.publish import StoredTable
from lonja.session import written

ROWS, BATCH, SIGN = "cell_rows", "cell_batch", "_sign"


@dataclass(frozen=True)
class RollUp:
    """``sums``: the value that a row adds to each measure; NULL adds nothing."""

    keys: tuple[str, ...]
    sums: Mapping[str, Column]

    def build(self, rows: DataFrame) -> DataFrame:
        """All cells, from all rows."""
        return self._cells(rows.withColumn(SIGN, F.lit(1)), 0)

    def delta(self, old: DataFrame, new: DataFrame, batch: int) -> DataFrame:
        """What the cells gain: ``old`` and ``new`` are the images of the changed rows before and after; batches are numbered upwards from 1."""
        return self._cells(old.withColumn(SIGN, F.lit(-1)).unionByName(new.withColumn(SIGN, F.lit(1))), batch)

    def _cells(self, rows: DataFrame, batch: int) -> DataFrame:
        added = [F.sum(F.col(SIGN) * F.coalesce(value, F.lit(0))).alias(name) for name, value in self.sums.items()]
        cells = rows.groupBy(*self.keys).agg(*added, F.sum(SIGN).cast("long").alias(ROWS))
        return cells.withColumn(BATCH, F.lit(batch).cast("long"))

    def applied(self, cells: DataFrame, delta: DataFrame) -> DataFrame:
        """Cells after a delta.  A cell that has seen the batch already keeps its sums, so that a batch may run again."""
        names = [*self.sums, ROWS]
        keys = [c for c in cells.columns if c not in names and c != BATCH]
        both = cells.withColumn("_stored", F.lit(True)).unionByName(delta.select(*cells.columns).withColumn("_stored", F.lit(False)))
        stored = F.col("_stored")
        summed = both.groupBy(*keys).agg(
            *[F.coalesce(F.sum(F.when(stored, F.col(c))), F.lit(0)).alias(f"_had_{c}") for c in names],
            *[F.coalesce(F.sum(F.when(~stored, F.col(c))), F.lit(0)).alias(f"_new_{c}") for c in names],
            F.coalesce(F.max(F.when(stored, F.col(BATCH))), F.lit(-1)).alias("_seen"), F.max(BATCH).alias(BATCH),
            F.coalesce(F.max(F.when(~stored, F.col(BATCH))), F.lit(-1)).alias("_batch"))
        fresh = F.col("_batch") > F.col("_seen")
        out = summed.select(*keys, BATCH, *[(F.col(f"_had_{c}") + F.when(fresh, F.col(f"_new_{c}")).otherwise(0)).cast(cells.schema[c].dataType).alias(c)
                                            for c in names])
        return out.where(F.col(ROWS) > 0).select(*cells.columns)

    def open_cells(self, table: StoredTable, delta: DataFrame) -> DataFrame:
        """The part of a delta that changes a stored cell: not what a cell has seen, nor what leaves no rows in an absent one."""
        keys = [*self.keys]
        seen = table.read_for(delta).select(*[F.col(k).alias(f"_at_{k}") for k in keys], F.col(BATCH).alias("_seen"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys])
        adds = F.when(F.col("_seen").isNull(), F.col(ROWS) > 0).otherwise(F.col("_seen") < F.col(BATCH))
        return delta.join(seen, same, "left").where(adds).select(*delta.columns)

    def maintain(self, table: StoredTable, delta: DataFrame) -> None:
        """Apply a delta to the stored cells; only partitions with a changed cell are written, none when a batch runs again."""
        delta = written(delta, "delta")
        table.merge(self.open_cells(table, delta), how=lambda cells, fresh, _keys, _order: self.applied(cells, fresh), rows_may_move=False)
