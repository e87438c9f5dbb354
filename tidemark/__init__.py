"""tidemark: trade and logistics analytics as PySpark jobs.

Sheet-like inputs are landed, typed, checked, loaded into a normalized core and rolled up
into monthly marts.  Every step is a function from DataFrames to DataFrames.
"""

__version__ = "0.1.0"
