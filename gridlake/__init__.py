"""gridlake: Spark-first analytics for electricity-distribution asset tables."""

__version__ = "0.1.0"
