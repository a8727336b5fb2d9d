"""All queries: importing the modules registers them."""

from mosaiq.operators import compositing, diffing, documents, hierarchy, metadata, nesting, pixels, planning, statistics, tiling  # noqa: F401
from mosaiq.registry import ORACLES, QUERIES  # noqa: F401
from mosaiq.sources import queries, readers, regions, tilestore  # noqa: F401
from mosaiq.streaming import sessions  # noqa: F401
from mosaiq.operators import scopes  # noqa: F401, I001  it builds on sessions
