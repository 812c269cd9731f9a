"""Spark operators for publishing trustworthy, location-based price data."""

__version__ = "0.1.0"
