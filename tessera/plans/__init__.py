"""The front end: a context with a catalog and SQL, frames, and results."""

from .context import EngineContext
from .frame import Frame
from .result import Result

__all__ = ["EngineContext", "Frame", "Result"]
