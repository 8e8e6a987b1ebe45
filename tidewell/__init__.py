"""tidewell: a Spark-native engine for network-flow records."""
