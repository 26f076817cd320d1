"""A Spark-native record-linkage and data-processing engine."""
