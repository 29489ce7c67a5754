"""Operators of training-data pipelines. Nothing else in walkloom imports this package."""
