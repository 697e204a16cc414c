"""Repetition analytics of text and DNA on Spark."""

__version__ = "0.1.0"
