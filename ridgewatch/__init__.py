"""PySpark-native analytics for aerial search-and-rescue telemetry, detections and corpora."""

__all__ = ["session"]
