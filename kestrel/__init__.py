"""kestrel: a Spark-native business-analytics operator library.

Every operator takes DataFrames (plus column names and parameters) and returns a
DataFrame.  Nothing data-sized is collected to the driver; the only driver-side
values are column names, one-row statistics and bounded top-k lists.
"""

from kestrel.session import get_spark, checkpoint_dir, Tables

__all__ = ["get_spark", "checkpoint_dir", "Tables"]
