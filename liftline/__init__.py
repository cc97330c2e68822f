"""liftline: weekly retail promotion and price-response analytics on Spark.

Every operator takes DataFrames and parameters and returns a lazy DataFrame
that covers all groups at once.
"""

__version__ = "0.1.0"
