"""Cohort-graph analytics on Spark: every operator is one DataFrame job over all graphs."""

__version__ = "0.1.0"
