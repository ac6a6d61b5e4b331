"""graphloom: a Spark-native engine for querying software repositories as data."""
