"""findloom: a PySpark-native analytics engine for static-analysis findings."""
