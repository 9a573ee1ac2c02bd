"""Spark-native analytics for industrial network telemetry."""

from tidegauge.session import build_session, materialise, shared_dir, use_utc

__all__ = ["build_session", "materialise", "shared_dir", "use_utc"]
