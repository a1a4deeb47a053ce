"""Operators for large-scale training-data pipelines. Nothing else in textloom imports this subpackage."""
