"""Field-sales analytics on Spark: scores, scoped reads, KPI roll-ups and change sets."""

from fieldbeat.operators.scope import Caller
from fieldbeat.sources.tables import Tables

__all__ = ["Caller", "Tables"]
