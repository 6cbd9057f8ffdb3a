"""Every registered query and its SQL twin."""

from signalweir.registry import beliefs, documents, graph, logs, reporting, signals, streams  # noqa: F401
from signalweir.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
