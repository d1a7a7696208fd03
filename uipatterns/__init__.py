"""Spark operators for finding potentially manipulative interface wording."""

__version__ = "0.1.0"
