"""foliograph: Spark-native analytics over documentation corpora."""
