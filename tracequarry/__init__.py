"""Spark-native analytics over traces of distributed training jobs."""
