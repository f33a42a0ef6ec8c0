"""Trajectory analytics on Spark DataFrames.

Every operator is a lazy ``DataFrame -> DataFrame`` function that takes its key
columns as a list, so the same code serves authors, suppliers, users or
conversations.
"""

__version__ = "0.1.0"
