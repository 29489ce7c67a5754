"""Operators over graphs and sequences: DataFrame in, DataFrame out."""
