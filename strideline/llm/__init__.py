"""Operators for large text corpora (training-data preparation), each a function from DataFrame to DataFrame."""
