"""Operators for training-data pipelines: scans, cleaning, selection, output.

Nothing else in the library imports this subpackage.
"""
