"""A Spark-native SQL analytics engine."""
