"""Operators that prepare text corpora for model training, all as Spark jobs."""
