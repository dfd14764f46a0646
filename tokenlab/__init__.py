"""tokenlab: a PySpark-native engine for multi-sample generation runs."""
