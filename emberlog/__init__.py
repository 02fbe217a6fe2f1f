"""PySpark-native analytics for operating-system logs."""
