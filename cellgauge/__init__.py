"""cellgauge: a Spark-native analytics engine for network-reliability data."""
