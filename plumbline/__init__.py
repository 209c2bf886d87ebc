"""Schema and data reconciliation on Spark."""

__version__ = "0.1.0"
