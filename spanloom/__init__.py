"""Spark-native record linkage over several sources."""
