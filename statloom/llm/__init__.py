"""Operators for large training-data pipelines. Nothing else in statloom imports this package."""
