"""stagecraft: a Spark-native engine for sales-pipeline snapshots and reports.

Operators are plain functions DataFrame -> DataFrame built from Spark SQL
expressions, joins, aggregates and windows (no Python UDFs).
"""

__version__ = "0.1.0"
