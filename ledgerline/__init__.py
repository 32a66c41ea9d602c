"""ledgerline: operations analytics for a small service business, on Spark.

Every operator is a function DataFrame(s) -> DataFrame built from the
DataFrame API, so Catalyst plans, prunes and pushes filters into the scans.
"""

__version__ = "0.1.0"
