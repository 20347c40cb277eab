"""Operators that Spark has no function for, made of its joins, shuffles and Arrow batches."""
