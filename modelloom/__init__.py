"""PySpark-native analysis of business-intelligence projects at fleet scale."""
