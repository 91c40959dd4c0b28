"""Operators for preparing training data: dedup, decontamination, filters, search and packing.

Nothing else in the package imports this folder.
"""
