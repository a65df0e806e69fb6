"""indicata: Spark-native profiling of long-format indicator tables.

The data model is one long table of (country, year, indicator, value)
observations with source and country-classification metadata.  Every
operator is a ``DataFrame -> DataFrame`` function built from Spark's
DataFrame API so that Catalyst plans it and the work is distributed.
"""

from indicata.profile import ColumnProfile, DEFAULT_PROFILE

__all__ = ["ColumnProfile", "DEFAULT_PROFILE"]
