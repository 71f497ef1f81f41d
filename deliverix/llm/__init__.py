"""Training-data operators: ten corpus jobs that run on Spark, one module each."""
