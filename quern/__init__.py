"""A Spark-first engine for research tables over crawled sites, and for training-data pipelines."""
