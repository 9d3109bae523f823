"""txnflow: transaction-sequence analytics as Spark DataFrame operators.

Every public operator is a function ``DataFrame -> DataFrame`` (or returns a
small, bounded result).  Nothing here holds a global SparkSession; callers pass
their own.  See README.md for the map from the reference's stages to modules.
"""

__version__ = "0.1.0"
