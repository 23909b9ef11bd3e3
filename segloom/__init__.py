"""Segment analytics on PySpark: relational operators over bilingual document segments."""

__version__ = "0.1.0"
