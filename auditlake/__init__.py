"""A Spark-native audit of text and configuration for secrets and misconfiguration."""

from auditlake.model import ScanOptions

__all__ = ["ScanOptions"]
