"""Tabular preparation and two-stage classification as Spark jobs."""

__version__ = "0.1.0"
