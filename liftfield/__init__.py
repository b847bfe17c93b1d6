"""Geo-experiment and media-mix analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
