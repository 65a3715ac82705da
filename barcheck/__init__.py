"""Market-data quality checks and trading-signal evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
