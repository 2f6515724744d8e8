"""A recommendation-data library on PySpark: DataFrame functions, no engine of its own."""
