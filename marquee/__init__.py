"""A Spark-native recommendation and library-audit engine."""
