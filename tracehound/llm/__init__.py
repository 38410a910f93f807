"""Training-data operators: ten independent corpus operators on Spark DataFrames.

Nothing outside this subpackage imports it."""
