"""Named queries over the star-schema tables."""

from heronry.plans import corpus, detection, evaluation, extra, files, fitted, indexed, lifecycle, reports, rollups, streamed, trajectory  # noqa: F401
from heronry.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
