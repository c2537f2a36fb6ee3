"""Subgroup analytics for text classifiers, as Spark DataFrame jobs."""
