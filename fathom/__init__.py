"""Text and vector retrieval as lazy Spark DataFrame composition."""

__version__ = "0.1.0"
