"""fieldglass: point-in-time sports and market analytics on Spark DataFrames."""

__version__ = "0.1.0"
