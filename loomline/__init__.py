"""A PySpark library for tables of timed records, scores and text."""
