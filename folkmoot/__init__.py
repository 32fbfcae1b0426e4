"""A PySpark-native engine for meeting records: parsing, joining, ranking and publishing as DataFrames."""
