"""The role tables every report reads, whatever storage they come from."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from lonja.functions.predicates import GHOST_STORE

ROLES = (
    "tickets", "lines", "payments", "items", "stores", "customers", "suppliers", "reps", "stock", "central_stock",
    "transfers", "invoices", "invoice_lines", "deliveries", "wholesale_orders", "purchase_orders", "purchase_lines",
    "receipts", "collections", "watermarks", "runs", "run_tables",
)


class Star:
    """Lazy role tables.  A binding implements ``_build(role)``."""

    ghost_store = GHOST_STORE

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._frames: dict[str, DataFrame] = {}

    def _build(self, role: str) -> DataFrame:
        raise NotImplementedError

    def __getattr__(self, role: str) -> DataFrame:
        if role not in ROLES:
            raise AttributeError(role)
        if role not in self._frames:
            self._frames[role] = self._build(role)
        return self._frames[role]


class FrameStar(Star):
    """Role tables given as DataFrames (tests, notebooks)."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], ghost_store: str = GHOST_STORE):
        super().__init__(spark)
        self._frames.update(frames)
        self.ghost_store = ghost_store


__all__ = ["ROLES", "FrameStar", "Star"]
