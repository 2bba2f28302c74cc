"""Larder: recipe and catalogue analytics expressed as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame, so that
Catalyst plans the whole question at once and nothing passes through the driver.
"""

__version__ = "0.1.0"
