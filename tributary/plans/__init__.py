"""Queries: functions (spark, sf_dir) -> DataFrame, and the SQL they are held against."""
