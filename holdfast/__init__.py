"""Spark-native customer-retention analytics: engagement panel in, retention decisions out."""

from holdfast.config import DEFAULT, Settings

__all__ = ["DEFAULT", "Settings"]
