"""memloom: a Spark-native analytics engine for long-lived agent memory."""
