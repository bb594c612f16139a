"""Spark-native analytics for baited underwater video surveys.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here collects detection-sized data to the driver.
"""

__version__ = "0.1.0"
