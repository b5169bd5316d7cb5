"""Features and models on `pyspark.ml`."""
