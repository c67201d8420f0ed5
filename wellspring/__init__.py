"""Spatial-phenotyping analytics on Spark: functions from DataFrame to DataFrame, keyed by plate and well."""
