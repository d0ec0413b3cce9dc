"""Expression builders: columns, literals, casts, comparisons, logic, arithmetic and aggregates."""

from .expressions import *  # noqa: F403
from .expressions import __all__  # noqa: F401
