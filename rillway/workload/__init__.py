from rillway.workload import functions, joins, sinks, sources, steps, streams  # noqa: F401
from rillway.workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
