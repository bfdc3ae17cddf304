"""larkspur: a PySpark-native analytics engine (DataFrame and SQL first)."""
