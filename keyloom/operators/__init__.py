"""Operators: DataFrame in, DataFrame out, over all keys at once."""
