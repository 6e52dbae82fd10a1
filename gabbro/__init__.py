"""gabbro: medallion-style analytics as declarative PySpark programs."""

__version__ = "0.1.0"
