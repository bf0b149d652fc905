"""Operators that prepare training data for language models, each a set of Spark jobs."""
