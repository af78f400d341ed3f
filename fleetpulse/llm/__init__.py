"""Operators that prepare text collections for training, each a Spark job of its own."""
