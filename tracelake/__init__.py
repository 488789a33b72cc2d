"""tracelake: debug-trace and patch-evaluation analytics on Spark DataFrames.

Operators take and return DataFrames and can be chained with ``df.transform``;
functions take and return Columns.
"""

__version__ = "0.1.0"
