"""sabermill: Spark-first operators for time-stamped entity statistics and quotes."""

__version__ = "0.1.0"
