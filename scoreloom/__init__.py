"""Evaluation analytics on Spark: score text pairs, keep results, summarise policies."""

from scoreloom.session import attach, build_session

__all__ = ["attach", "build_session"]
