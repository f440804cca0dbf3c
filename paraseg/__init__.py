"""Machine-translation evaluation over parallel segments, as Spark jobs."""

__version__ = "0.1.0"
