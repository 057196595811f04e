"""Spark-native analytics over song texts: ETL, statistics, phrases and topics."""
