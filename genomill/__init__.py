"""PySpark-native genotype analytics: variants x samples tables as DataFrames."""

__version__ = "0.1.0"
