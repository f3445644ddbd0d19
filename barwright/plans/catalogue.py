"""All queries: importing the operator modules registers them."""

from ..operators import alignment, binding, candles, constraints, indicators, paths, plan, probability, quality, relational, reports, sentiment, strokes, waves  # noqa: F401
from ..sources import bars, feed, ingest  # noqa: F401
from ..streaming import signals  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
