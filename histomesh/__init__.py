"""Spark DataFrame operators for spatially resolved single-cell cohorts."""
