"""An analytics engine on Spark: sources, a small DataFrame API, SQL, and result helpers over Catalyst."""

from .plans import EngineContext, Frame, Result

__all__ = ["EngineContext", "Frame", "Result"]
